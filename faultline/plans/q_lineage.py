"""Queries over manifests: symbols, edges, scores and lineage walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..operators import errors, lineage
from ..session import stage
from . import duck as D
from .q_logs import IDS, sliced
from .registry import Inputs, query

_MODEL = "('model', 'snapshot', 'seed')"
PROFILES = f"""
profiles as (select *, lower(text) as lowered, {D.node_symbols('name', 'path', 'text')} as symbols from (
  select n.run_key, n.id, n.pos, n.name, n.path, coalesce(f.text, '') as text from v_nodes n
  left join v_files f on f.run_key = n.run_key and f.path = n.path where n.resource_type in {_MODEL}) p)"""
UP = """
up_edges as (select d.run_key, d.id as src, d.dep_id as dst, min(d.pos) as pos from v_deps d
  join profiles m on m.run_key = d.run_key and m.id = d.dep_id group by 1, 2, 3)"""
DOWN = """
down_edges as (select d.run_key, d.id as src, d.child_id as dst, min(d.pos) as pos from v_child_map d
  join profiles m on m.run_key = d.run_key and m.id = d.child_id group by 1, 2, 3)"""
SCORE = """list_sum(list_transform({signals}, lambda s: case when list_contains({sym}, s) then 3
  when s <> '' and contains({low}, s) then 1 else 0 end))"""
TESTED = f"""
tested as (select d.run_key, d.id, row_number() over (partition by d.run_key, d.id order by d.pos) as n, d.dep_id as model_id
  from v_deps d join v_nodes t on t.run_key = d.run_key and t.id = d.id and t.resource_type = 'test'
  join v_nodes m on m.run_key = d.run_key and m.id = d.dep_id and m.resource_type in {_MODEL})"""


def profiles(i: Inputs) -> DataFrame:
    return lineage.profiles(i.v_nodes, i.v_files)


def own_signals(node_profiles: DataFrame) -> DataFrame:
    """Signals for a walk from every node: what its source calls and refers to, and its name."""
    found = S.union(S.refs(F.col("text")), S.macro_calls(F.col("text")), F.array(F.lower("name")))
    return node_profiles.select("run_key", F.col("id").alias("root_id"), found.alias("signals"))


def walk_sql(edges: str, cap: int, gate: str, roots: str) -> str:
    """Level by level, without any cut before the final cap; ``roots(run_key, root_id, signals)``."""
    return f"""
    l1 as (select r.run_key, r.root_id, e.dst as node_id, e.pos, coalesce({SCORE.format(signals='r.signals', sym='p.symbols', low='p.lowered')}, 0) as score
      from {roots} r join {edges} e on e.run_key = r.run_key and e.src = r.root_id and e.dst <> r.root_id
      join profiles p on p.run_key = e.run_key and p.id = e.dst),
    r1 as (select *, row_number() over (partition by run_key, root_id order by score desc, pos) as rank from l1 qualify rank <= {cap}),
    es as (select e.run_key, e.src, e.dst, e.pos, {SCORE.format(signals='a.symbols', sym='b.symbols', low='b.lowered')} as score
      from {edges} e join profiles a on a.run_key = e.run_key and a.id = e.src join profiles b on b.run_key = e.run_key and b.id = e.dst),
    l2 as (select r.run_key, r.root_id, es.dst as node_id, r.rank, es.score, es.pos, es.src as parent_id
      from r1 r join es on es.run_key = r.run_key and es.src = r.node_id and es.dst <> r.root_id
      where {gate} and not exists (select 1 from r1 x where x.run_key = r.run_key and x.root_id = r.root_id and x.node_id = es.dst)),
    d2 as (select * from l2 qualify row_number() over (partition by run_key, root_id, node_id order by rank, score desc, pos) = 1),
    walked as (select *, row_number() over (partition by run_key, root_id order by depth, rank, score2 desc, pos) as ord from (
      select run_key, root_id, node_id, 1 as depth, root_id as parent_id, rank, score, 0 as score2, pos from r1
      union all select run_key, root_id, node_id, 2, parent_id, rank, score, score, pos from d2) u
      qualify ord <= {cap})"""


ALL_ROOTS = f"""
all_roots as (select run_key, id as root_id, {D.union(D.refs('text'), D.macro_calls('text'), '[lower(name)]')} as signals from profiles)"""
_WALK_COLUMNS = "select run_key, root_id, ord, depth, node_id, parent_id, cast(score as int) as score from walked"


@query("node_symbols", ctes=PROFILES, sql=f"select run_key, id, {D.joined('symbols')} as symbols from profiles")
def node_symbols(i: Inputs) -> DataFrame:
    found = lineage.profiles(i.v_nodes, i.v_files, texts=False)
    return found.select("run_key", "id", F.array_join(F.array_sort("symbols"), ",").alias("symbols"))


@query("upstream_edges", ctes=f"{PROFILES},{UP}", sql="select run_key, src, pos, dst from up_edges")
def upstream_edges(i: Inputs) -> DataFrame:
    return lineage.upstream_edges(i.v_nodes, i.v_deps)


@query("downstream_edges", ctes=f"{PROFILES},{DOWN}", sql="select run_key, src, pos, dst from down_edges")
def downstream_edges(i: Inputs) -> DataFrame:
    return lineage.downstream_edges(i.v_nodes, i.v_child_map)


@query("tested_models", ctes=TESTED, sql="select run_key, id, n, model_id from tested")
def tested_models(i: Inputs) -> DataFrame:
    return lineage.tested_models(i.v_nodes, i.v_deps)


@query(
    "nodes_of_files",
    sql=f"""select f.run_key, f.path as file, arg_min(n.id, n.pos) as node_id from v_files f left join v_nodes n
        on n.run_key = f.run_key and n.resource_type in {_MODEL} and n.path <> ''
        and (n.path = f.path or {D.stem('f.path')} = n.name or {D.stem('f.path')} = {D.stem('n.path')}) group by 1, 2""",
)
def nodes_of_files(i: Inputs) -> DataFrame:
    return lineage.find_nodes(i.v_files.select("run_key", F.col("path").alias("file")), i.v_nodes, few=False)


FAILING = IDS + f""",
failing as (select run_key, regexp_extract(t, '(?i)\\bFailure\\s+in\\s+test\\s+([\\w.$-]+)', 1) as test_name from (
  select run_key, string_agg(line, chr(10) order by line_no) as t from sliced group by 1) s
  where regexp_matches(t, '(?i)\\bFailure\\s+in\\s+test\\s+([\\w.$-]+)')),
case_tests as (select f.run_key, arg_min(t.id, t.pos) as test_id from (select run_key, {D.last_part('test_name')} as c from failing) f
  join v_nodes t on t.run_key = f.run_key and t.resource_type = 'test'
  and (t.name = c or t.alias = c or contains(t.id, '.' || c || '.') or ends_with(t.id, '.' || c)) group by 1)"""


@query("failing_tests", ctes=FAILING, sql="select run_key, test_id from case_tests")
def failing_tests(i: Inputs) -> DataFrame:
    return lineage.find_tests(errors.failing_tests(sliced(i)), i.v_nodes)


@query(
    "edge_scores",
    ctes=f"{PROFILES},{UP}",
    sql=f"""select e.run_key, e.src, e.dst, cast({SCORE.format(signals='a.symbols', sym='b.symbols', low='b.lowered')} as int) as score,
        row_number() over (partition by e.run_key, e.src order by {SCORE.format(signals='a.symbols', sym='b.symbols', low='b.lowered')} desc, e.pos) as rank
        from up_edges e join profiles a on a.run_key = e.run_key and a.id = e.src join profiles b on b.run_key = e.run_key and b.id = e.dst""",
)
def edge_scores(i: Inputs) -> DataFrame:
    scored = lineage.edge_scores(lineage.upstream_edges(i.v_nodes, i.v_deps), stage(profiles(i), "profiles"))
    order = Window.partitionBy("run_key", "src").orderBy(F.desc("score"), "pos")
    return scored.select("run_key", "src", "dst", "score", F.row_number().over(order).alias("rank"))


@query(
    "upstream_walks",
    ctes=f"{PROFILES},{UP},{ALL_ROOTS},{walk_sql('up_edges', 6, 'es.score > 0', 'all_roots')}",
    sql=_WALK_COLUMNS,
)
def upstream_walks(i: Inputs) -> DataFrame:
    found = stage(profiles(i), "profiles")
    roots = found.select("run_key", F.col("id").alias("root_id"))
    return lineage.upstream(roots, own_signals(found), lineage.upstream_edges(i.v_nodes, i.v_deps), found)


@query(
    "impact_walks",
    ctes=f"{PROFILES},{DOWN},{ALL_ROOTS},{walk_sql('down_edges', 5, 'true', 'all_roots')}",
    sql=_WALK_COLUMNS,
)
def impact_walks(i: Inputs) -> DataFrame:
    found = stage(profiles(i), "profiles")
    roots = found.select("run_key", F.col("id").alias("root_id"))
    return lineage.impact(roots, own_signals(found), lineage.downstream_edges(i.v_nodes, i.v_child_map), found)
