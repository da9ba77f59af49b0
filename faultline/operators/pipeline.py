"""The whole way from logs and manifests to contexts, over all failed runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import sieve, stage
from ..settings import SHRINKING_PROVIDER
from ..sources.logs import latest_slice
from . import context as C
from . import changes, errors, lineage
from .mentions import mentions


BY_ID = {"run_key": "run_key", "id": "id"}
BY_PATH = {"run_key": "run_key", "path": "path"}


@dataclass
class Project:
    """Tables of all projects, keyed by ``run_key``."""

    nodes: DataFrame
    macros: DataFrame
    sources: DataFrame
    deps: DataFrame
    macro_deps: DataFrame
    child_map: DataFrame
    files: DataFrame


def blamed_files(lines: DataFrame, ledger: DataFrame, p: Project) -> DataFrame:
    return errors.error_files(lines, ledger, p.nodes, p.macros, p.deps, p.files)


def case_diffs(cases: DataFrame, files: DataFrame, base: DataFrame) -> DataFrame:
    """(run_key, primary, diff) of the cases' files: no other file is shuffled or compared."""
    shown = stage(cases.select("run_key", F.col("primary").alias("path")).distinct(), "shown")
    head, before = (sieve(df, shown, BY_PATH).join(shown, ["run_key", "path"], "left_semi") for df in (files, base))
    return changes.diff_texts(changes.line_changes(head, before, based=base))


def failure_contexts(
    lines: DataFrame,
    ledger: DataFrame,
    blamed: DataFrame,
    p: Project,
    provider: str = "",
    diffs: DataFrame | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """(run_key, file, primary, context) for each blamed file that can be read.

    Only runs that failed take part: manifests are cut down to them before anything else.  ``diffs`` are given, or
    made from ``base``, the files of the commit before, for the files that contexts show.
    """
    shrink = provider.lower() == SHRINKING_PROVIDER
    runs = stage(blamed.select("run_key", "file").distinct(), "blamed")
    keys = runs.select("run_key").distinct()

    def of_runs(df: DataFrame) -> DataFrame:
        return df.join(keys, "run_key", "left_semi")

    nodes, files, deps = of_runs(p.nodes), of_runs(p.files), of_runs(p.deps)
    slices = stage(latest_slice(of_runs(lines), ledger), "slices")
    found_in_slices = stage(mentions(slices), "mentions")
    failing = errors.failing_tests(slices, found_in_slices)
    tests = stage(lineage.find_tests(failing, nodes), "failing-tests")
    # each table is cut to the rows asked for where it lies: what is shuffled grows with the cases, not with the projects
    test_ids = tests.select("run_key", F.col("test_id").alias("id"))
    test_deps = stage(sieve(deps, test_ids, BY_ID).join(test_ids, ["run_key", "id"], "left_semi"), "test-deps")
    asked = test_ids.unionByName(test_deps.select("run_key", F.col("dep_id").alias("id")))
    test_nodes = stage(sieve(nodes, asked, BY_ID), "test-nodes")
    tested = stage(lineage.tested_models(test_nodes, test_deps), "tested")

    primary = stage(C.primary_files(runs, tests, tested, test_nodes), "primary")
    found = lineage.find_nodes(primary.select("run_key", F.col("primary").alias("file")).distinct(), nodes)
    primary = C.usable_files(primary, sieve(files, primary, {"run_key": "run_key", "path": "primary"}))
    cases = stage(
        primary.join(
            found.select("run_key", F.col("file").alias("primary"), F.col("node_id").alias("root_id")), ["run_key", "primary"], "left"
        ),
        "cases",
    )
    roots = stage(C.gated_roots(cases, errors.lineage_gate(slices, failing)), "roots")
    diagnosed = roots.filter(~T.has_part(F.col("primary"), "macros"))

    up_edges = stage(lineage.near_edges(roots, deps, lambda d: lineage.upstream_edges(sieve(nodes, d, {"run_key": "run_key", "id": "dep_id"}), d)), "up-edges")
    down_edges = stage(lineage.near_edges(roots, p.child_map, lambda d: lineage.downstream_edges(sieve(nodes, d, {"run_key": "run_key", "id": "child_id"}), d)), "down-edges")
    edges = up_edges.unionByName(down_edges)
    near = (
        roots.select("run_key", F.col("root_id").alias("id"))
        .unionByName(edges.select("run_key", F.col("dst").alias("id")))
        .unionByName(tested.select("run_key", F.col("model_id").alias("id")))
        .distinct()
    )
    near_nodes = stage(sieve(nodes, near, BY_ID).join(near, ["run_key", "id"], "left_semi"), "near-nodes")
    profiles = stage(lineage.profiles(near_nodes, sieve(files, near_nodes, BY_PATH)), "profiles")

    run_signals = stage(lineage.log_signals(slices).unionByName(C.test_signals(tests, test_nodes, tested)).distinct(), "run-signals")
    of_run = lineage.run_parts(run_signals)
    own = lineage.own_signals(roots, profiles).distinct().join(run_signals, ["run_key", "signal"], "left_anti")
    own_parts = stage(lineage.signal_parts(own), "own-signals")
    # only shortened blocks ask for the signals of each root as a whole
    parts = stage(lineage.signal_parts(lineage.root_signals(roots, run_signals, profiles)), "signals") if shrink else own_parts

    cards = (
        diagnosed.select("run_key", "root_id").distinct()
        .join(tests, "run_key").join(C.test_cards(tests, test_nodes, tested), ["run_key", "test_id"])
        .select("run_key", "root_id", F.lit(0).cast("long").alias("seq"), F.lit("test_failure").alias("key"), "text")
    )
    at_root = {"run_key": "run_key", "id": "root_id"}
    picks = stage(C.macro_picks(diagnosed, profiles, p.macros, sieve(p.macro_deps, diagnosed, at_root)), "macro-picks")
    sources = of_runs(p.sources)
    up = lineage.upstream(diagnosed, own_parts, up_edges, profiles, of_run)
    sections = (
        cards.unionByName(C.test_model_sections(C.related_tests(diagnosed, tests, tested, profiles), parts, shrink))
        .unionByName(C.walk_sections(up, parts, profiles, "UPSTREAM_MODEL", shrink))
        .unionByName(
            C.macro_sections(picks, profiles, sieve(files, picks, BY_PATH), shrink)
        )
        .unionByName(
            C.definition_sections(
                diagnosed, slices, parts, near_nodes, sieve(deps, diagnosed, at_root), sources, files, shrink,
                found_in_slices,
            )
        )
    )
    down = lineage.impact(roots, own_parts, down_edges, profiles, of_run)
    impacts = C.walk_sections(down, parts, profiles, "DOWNSTREAM_MODEL", shrink)
    if diffs is None and base is not None:
        diffs = case_diffs(cases, files, of_runs(base))
    if diffs is None:
        diffs = cases.select("run_key", "primary").distinct().withColumn("diff", F.lit("NO_DIFF"))
    return C.file_contexts(
        cases,
        C.joined_sections(C.merge_sections(sections), "diagnostic"),
        C.joined_sections(impacts, "impact"),
        C.compiled_blocks(slices, files, shrink),
        diffs,
    )
