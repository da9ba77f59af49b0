"""One small project from manifest file to context and prompt."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.operators import changes, errors, pipeline
from faultline.sources import logs, manifest

FILES = {
    "models/fin/fact_sales.sql": "select shop_key from {{ ref('prep_shops') }}",
    "models/prep/prep_shops.sql": "select shop_key from {{ ref('load_shops') }}",
    "models/prep/load_shops.sql": "select 1 as raw_key",
    "models/fin/shop_report.sql": "select shop_key from {{ ref('fact_sales') }}",
    "models/fin/board.sql": "select kpi from {{ ref('shop_report') }}",
    "models/fin/_doc.yml": "models:\n  - name: fact_sales\n    columns:\n      - name: shop_key",
    "models/dim_shop.sql": "select {{ hash_key('x') }} as shop_key from {{ source('erp', 'shops') }}",
    "macros/hash.sql": "{% macro hash_key(x) %} md5({{ x }}) {% endmacro %}",
    "target/compiled/app/fact_sales.sql": "select shop_key from prep_shops",
}
CHAIN = ["load_shops", "prep_shops", "fact_sales", "shop_report", "board"]
PATHS = {p.rsplit("/", 1)[-1][:-4]: p for p in FILES if p.startswith("models") and p.endswith(".sql")}


def _node(name, parents=()):
    return {"resource_type": "model", "name": name, "original_file_path": PATHS[name], "depends_on": {"nodes": [f"model.app.{p}" for p in parents]}}


@pytest.fixture
def tables(spark, tmp_path):
    nodes = {f"model.app.{n}": _node(n, CHAIN[k - 1 : k] if k else ()) for k, n in enumerate(CHAIN)}
    nodes["model.app.dim_shop"] = {**_node("dim_shop"), "depends_on": {"nodes": ["source.app.erp.shops"], "macros": ["macro.app.hash_key"]}}
    nodes["test.app.fits_fact_sales.9f"] = {
        "resource_type": "test", "name": "fits_fact_sales_shop_key", "original_file_path": "models/fin/_doc.yml", "column_name": "shop_key",
        "test_metadata": {"name": "relationships", "kwargs": {"to": "ref('dim_shop')", "values": ["a_1", 0, {"k": "b_2"}], "n": 3}},
        "depends_on": {"nodes": ["model.app.fact_sales", "model.app.dim_shop"]},
    }
    body = {
        "nodes": nodes,
        "macros": {"macro.app.hash_key": {"name": "hash_key", "original_file_path": "macros/hash.sql"}},
        "sources": {"source.app.erp.shops": {"name": "shops", "original_file_path": "models/fin/_doc.yml"}},
        "child_map": {f"model.app.{a}": [f"model.app.{b}"] for a, b in zip(CHAIN, CHAIN[1:])},
    }
    for key, text in (("run1", json.dumps(body)), ("broken", '{"nodes": {"a": ')):
        target = tmp_path / key / "target"
        target.mkdir(parents=True)
        (target / "manifest.json").write_text(text)
    found = manifest.read_manifests(spark, str(tmp_path))
    assert [r["run_key"] for r in found.collect()] == ["run1"]
    files = spark.createDataFrame([("run1", p, t) for p, t in FILES.items()], "run_key string, path string, text string")
    return pipeline.Project(
        nodes=manifest.nodes(found), macros=manifest.named_entries(found, "macros"), sources=manifest.named_entries(found, "sources"),
        deps=manifest.deps(found), macro_deps=manifest.macro_deps(found), child_map=manifest.child_map(found), files=files,
    )


def context(spark, tables, text, provider=""):
    lines = spark.createDataFrame(
        [("run1", n, t) for n, t in enumerate(["=" * 30 + " t | id " + "=" * 30, *text.split("\n")])], "run_key string, line_no long, line string"
    )
    ledger = logs.run_ids(lines).withColumnRenamed("line_no", "seq")
    blamed = pipeline.blamed_files(lines, ledger, tables)
    return {r["file"]: r["context"] for r in pipeline.failure_contexts(lines, ledger, blamed, tables, provider).collect()}


TEST_LOG = (
    "Failure in test fits_fact_sales_shop_key (models/fin/_doc.yml)\ncolumn \"shop_key\" has no match at line 7\n"
    "compiled code at target/compiled/app/fact_sales.sql"
)


@pytest.mark.parametrize("provider", ["", "Ollama"])
def test_failed_test_gets_upstream_impact_and_definitions(spark, tables, provider):
    got = context(spark, tables, TEST_LOG, provider)
    assert list(got) == ["models/fin/fact_sales.sql"]
    primary, rest = got["models/fin/fact_sales.sql"].split("<DIAGNOSTIC_CONTEXT>")
    diagnostic, impact = rest.split("<IMPACT_CONTEXT>")
    assert 'SOURCE OF models/fin/fact_sales.sql:\nselect shop_key' in primary
    assert '<COMPILED_SQL path="target/compiled/app/fact_sales.sql" location="line 7">' in primary
    assert '<UPSTREAM_MODEL name="prep_shops" path="models/prep/prep_shops.sql" depth="1">' in diagnostic
    assert 'name="load_shops"' in diagnostic and "shop_report" not in diagnostic
    assert '<RELATED_TEST_MODEL name="dim_shop"' in diagnostic
    assert "type: relationships" in diagnostic and "to: ref('dim_shop')" in diagnostic
    assert '<SCHEMA_DEFINITION path="models/fin/_doc.yml">' in diagnostic
    assert ("models:\n" in diagnostic) is (provider == "")
    assert 'name="shop_report" path="models/fin/shop_report.sql" depth="1"' in impact
    assert 'name="board" path="models/fin/board.sql" depth="2"' in impact and "prep_shops" not in impact


def test_diffs_are_made_for_the_files_shown_only(spark, monkeypatch):
    cases = spark.createDataFrame([("r", "a.sql"), ("r", "a.sql"), ("s", "new.sql"), ("t", "b.sql"), (None, "a.sql")], "run_key string, primary string")
    schema = "run_key string, path string, text string"
    files = spark.createDataFrame([(r, p, "x\ny") for r in ("r", "s", "t", None) for p in ("a.sql", "b.sql", "new.sql")], schema)
    base = spark.createDataFrame([(r, p, "x\nz") for r in ("r", "s", None) for p in ("a.sql", "b.sql")], schema)
    compared = []
    line_changes = changes.line_changes
    monkeypatch.setattr(pipeline.changes, "line_changes", lambda head, *rest, **kw: compared.append(head) or line_changes(head, *rest, **kw))
    got = {(r["run_key"], r["primary"]): r["diff"] for r in pipeline.case_diffs(cases, files, base).collect()}
    # a file that is new in a run with a base is added, one of a run without a base has no diff
    assert got == {("r", "a.sql"): "-z\n+y", ("s", "new.sql"): "+x\n+y"}
    assert sorted((r["run_key"], r["path"]) for r in compared[0].collect()) == [("r", "a.sql"), ("s", "new.sql"), ("t", "b.sql")]


def test_syntax_error_keeps_the_primary_file_only(spark, tables):
    got = context(spark, tables, 'Database Error in model fact_sales (models/fin/fact_sales.sql)\nsyntax error at or near "from"')
    text = got["models/fin/fact_sales.sql"]
    assert "NO_DIAGNOSTIC_CONTEXT" in text and "NO_IMPACT_CONTEXT" in text and "prep_shops'" in text


def test_macros_and_sources_of_the_root(spark, tables):
    text = context(spark, tables, "Database Error in model dim_shop (models/dim_shop.sql)\ncolumn x does not exist")["models/dim_shop.sql"]
    assert '<MACRO_CONTEXT name="hash_key" path="macros/hash.sql">' in text
    assert '<SOURCE_DEFINITION name="shops" path="models/fin/_doc.yml">' in text


def test_nested_test_arguments_give_signals(spark, tables):
    from faultline.operators.context import test_signals
    from faultline.operators.lineage import tested_models

    tests = tables.nodes.filter("resource_type = 'test'").select("run_key", F.col("id").alias("test_id"))
    got = {r["signal"] for r in test_signals(tests, tables.nodes, tested_models(tables.nodes, tables.deps)).collect()}
    assert {"shop_key", "fits_fact_sales_shop_key", "fact_sales", "dim_shop", "a_1", "b_2"} <= got
    assert not {"k", "values", "to", "n"} & got  # keys are no leaves
    assert errors is not None


def test_leaves_at_any_depth(column):
    from faultline.operators.context import leaf_text

    assert column(leaf_text, '["a_1", 0, {"k": "b_2", "m": [true, "0", 1.5, null, "c\\"d"]}]').split() == ["a_1", "b_2", "True", "0", "1.5", 'c"d']
    assert column(leaf_text, "ref('x')") == "ref('x')"


def test_one_odd_field_leaves_the_rest_of_a_manifest(spark):
    from faultline.sources import manifest

    raw = spark.createDataFrame(
        [("a", '{"nodes": {"x": {"name": ["odd"], "alias": "al", "test_metadata": {"name": "t", "namespace": "ns_1", "kwargs": {"k": 1}}}}}'), ("b", "{")],
        "run_key string, json string",
    )
    (row,) = manifest.nodes(manifest.parse_manifests(raw)).collect()
    assert (row["run_key"], row["id"], row["alias"], row["test_kind"]) == ("a", "x", "al", "t")
    assert "ns_1" in row["metadata"]


def test_a_run_that_names_very_many_files_gives_each_root_its_first_ones(spark):
    """Forty yaml files in log order; some are blank, and each root leaves its own path out."""
    from faultline.operators.context import definition_sections

    names = [f"models/y{k}.yml" for k in range(40)]
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    lines = rows([("r", k, f"see {n} there") for k, n in enumerate(names)], "run_key string, line_no long, line string")
    files = rows([("r", n, "" if k == 1 else "  \n" if k == 2 else f"models: {k}") for k, n in enumerate(names)], "run_key string, path string, text string")
    nodes = rows([("r", f"n{k}", f"models/y{k}.yml" if k < 6 else f"models/m{k}.sql") for k in range(200)], "run_key string, id string, path string")
    roots = nodes.select("run_key", F.col("id").alias("root_id"))
    parts = roots.withColumn("signals", F.array(F.lit("zzz")))
    deps = rows([], "run_key string, id string, pos int, dep_id string")
    sources = rows([], "run_key string, id string, name string, path string")
    got = {}
    for r in definition_sections(roots, lines, parts, nodes, deps, sources, files).orderBy("root_id", "seq").collect():
        got.setdefault(r["root_id"], []).append(r["text"].split('"')[1])
    usable = [n for k, n in enumerate(names) if k != 1]  # without text; a blank one is shown as it is
    for k in range(200):
        assert got[f"n{k}"] == [n for n in usable if n != f"models/y{k}.yml"][:3], k
    shrunk = definition_sections(roots, lines, parts, nodes, deps, sources, files, shrink=True).filter("root_id = 'n100'").orderBy("seq").collect()
    assert [r["text"].split('"')[1] for r in shrunk] == [names[0], names[3], names[4]]
