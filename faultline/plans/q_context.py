"""Queries that assemble context for blamed files."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..operators import context as C
from ..operators import errors, lineage, pipeline
from ..session import stage
from ..settings import SHRINKING_PROVIDER
from . import duck as D
from .q_lineage import DOWN, FAILING, PROFILES, SCORE, TESTED, UP, profiles, walk_sql
from .q_logs import BLAME, CLEAN, blamed, ledger, mentions_sql, sliced
from .q_text import focus_sql
from .registry import Inputs, query

# --- check SQL -------------------------------------------------------------------------
CARDS = """
kwargs as (select run_key, id, ['column_name: ' || column_name, 'values: ["a_' || column_name || '", 0]'] as shown,
   column_name || ' a_' || column_name || ' ' as leaves from v_nodes where resource_type = 'test'),
cards as (select n.run_key, n.id as test_id,
  '<DBT_TEST_FAILURE>' || chr(10) || 'name: ' || n.name || chr(10) || 'type: ' || coalesce(n.test_kind, string_split(n.name, '_')[1]) || chr(10) ||
  'schema_file: ' || n.path || chr(10) || 'column: ' || n.column_name || chr(10) || array_to_string(k.shown, chr(10)) ||
  coalesce((select string_agg(chr(10) || 'depends_on_model: ' || m.name || ' (' || m.path || ')', '' order by t.n)
    from tested t join v_nodes m on m.run_key = t.run_key and m.id = t.model_id where t.run_key = n.run_key and t.id = n.id), '') ||
  chr(10) || '</DBT_TEST_FAILURE>' as text
  from v_nodes n join kwargs k on k.run_key = n.run_key and k.id = n.id)"""


def test_signal_sql(tests: str) -> str:
    return f"""
test_words as (select n.run_key, n.name || ' ' || n.column_name || ' ' || coalesce(n.test_kind, '') || ' ' || k.leaves as words
    from {tests} t join v_nodes n on n.run_key = t.run_key and n.id = t.test_id join kwargs k on k.run_key = n.run_key and k.id = n.id
  union all select t.run_key, m.name || ' ' || coalesce(m.alias, '') || ' ' || {D.stem('m.path')}
    from {tests} t join tested d on d.run_key = t.run_key and d.id = t.test_id join v_nodes m on m.run_key = d.run_key and m.id = d.model_id),
test_sig as (select distinct run_key, unnest({D.error_signals('words')}) as signal from test_words)"""


def macro_sql(roots: str) -> str:
    return f"""
mids as (
  select r.run_key, r.root_id, d.macro_id, 0 as kind, d.pos from {roots} r join v_macro_deps d on d.run_key = r.run_key and d.id = r.root_id
  union all
  select r.run_key, r.root_id, m.id, 1, m.pos from {roots} r join profiles p on p.run_key = r.run_key and p.id = r.root_id
    join v_macros m on m.run_key = r.run_key and list_contains({D.macro_calls('p.text')}, m.name)),
mfirst as (select run_key, root_id, macro_id, min((kind, pos)) as place from mids group by 1, 2, 3),
mtop as (select *, row_number() over (partition by run_key, root_id order by place, macro_id) as rank from mfirst qualify rank <= 4),
macro_blocks as (select t.run_key, t.root_id, row_number() over (partition by t.run_key, t.root_id order by rank) as n, m.name, m.path,
    '<MACRO_CONTEXT name="' || m.name || '" path="' || m.path || '">' || chr(10) || coalesce(f.text, '') || chr(10) || '</MACRO_CONTEXT>' as text
  from mtop t join v_macros m on m.run_key = t.run_key and m.id = t.macro_id left join v_files f on f.run_key = m.run_key and f.path = m.path)"""


def definition_sql(roots: str, source_body: str = "f.text", yaml_body: str = "f.text") -> str:
    return f"""
log_yaml as (select run_key, path, min((line_no, idx)) as place from (
    select run_key, line_no, idx, {D.source_path('path')} as path from (
      {mentions_sql("(select run_key, line_no, line as t from sliced) w", "run_key, line_no")}) m where pattern = 3) y
  where path like '%.yml' or path like '%.yaml' group by 1, 2),
defs as (
  select r.run_key, r.root_id, (0, d.pos, 0) as place, '<SOURCE_DEFINITION name="' || s.name || '" path="' || s.path || '">' || chr(10) ||
    coalesce({source_body}, '') || chr(10) || '</SOURCE_DEFINITION>' as text
  from {roots} r join v_deps d on d.run_key = r.run_key and d.id = r.root_id join v_sources s on s.run_key = d.run_key and s.id = d.dep_id
  left join v_files f on f.run_key = s.run_key and f.path = s.path
  union all
  select r.run_key, r.root_id, (1, y.place[1], y.place[2]), '<SCHEMA_DEFINITION path="' || y.path || '">' || chr(10) || {yaml_body} || chr(10) || '</SCHEMA_DEFINITION>'
  from {roots} r join log_yaml y on y.run_key = r.run_key join v_files f on f.run_key = y.run_key and f.path = y.path
  left join v_nodes n on n.run_key = r.run_key and n.id = r.root_id where f.text <> '' and y.path is distinct from n.path),
def_first as (select run_key, root_id, text, min(place) as place from defs group by 1, 2, 3),
def_blocks as (select *, row_number() over (partition by run_key, root_id order by place) as n from def_first qualify n <= 3)"""


def _block(label: str, name: str, path: str, depth: str, text: str) -> str:
    return (
        f"'<{label} name=\"' || {name} || '\" path=\"' || {path} || '\" depth=\"' || cast({depth} as varchar) || '\">' || chr(10) || "
        f"{text} || chr(10) || '</{label}>'"
    )


COMPILED = r"""
pointed as (select run_key, regexp_extract(t, '(?i)compiled code at\s+(target/[^\s]+\.sql)', 1) as path,
    nullif(regexp_extract(t, '\b(?:line|LINE)\s+\d+|\[\d+:\d+\]', 0), '') as location
  from (select run_key, string_agg(line, chr(10) order by line_no) as t from sliced group by 1) s),
compiled as (select p.run_key, '<COMPILED_SQL path="' || p.path || '"' || coalesce(' location="' || location || '"', '') || '>' || chr(10) || f.text ||
    chr(10) || '</COMPILED_SQL>' as compiled
  from pointed p join v_files f on f.run_key = p.run_key and f.path = p.path where f.text <> '')"""

ALL = "every as (select run_key, id as root_id from profiles)"
ALL_TESTS = "all_tests as (select run_key, id as test_id from v_nodes where resource_type = 'test')"


# --- inputs ----------------------------------------------------------------------------

def nodes(i: Inputs) -> DataFrame:
    """Nodes with test arguments, one of them nested."""
    nested = F.concat(F.lit('["a_'), F.col("column_name"), F.lit('", 0]'))
    pairs = F.array(
        F.struct(F.lit("column_name").alias("key"), F.col("column_name").alias("value")),
        F.struct(F.lit("values").alias("key"), nested.alias("value")),
    )
    return i.v_nodes.withColumn("kwargs", F.when(F.col("resource_type") == "test", pairs))


def project(i: Inputs) -> pipeline.Project:
    return pipeline.Project(
        nodes=nodes(i), macros=i.v_macros, sources=i.v_sources, deps=i.v_deps, macro_deps=i.v_macro_deps,
        child_map=i.v_child_map, files=i.v_files,
    )


def _all_roots(found: DataFrame) -> DataFrame:
    return found.select("run_key", F.col("id").alias("root_id"))


def _all_tests(i: Inputs) -> DataFrame:
    return i.v_nodes.filter("resource_type = 'test'").select("run_key", F.col("id").alias("test_id"))


# --- queries ---------------------------------------------------------------------------

@query(
    "primary_files",
    ctes=f"{FAILING},{TESTED}",
    sql="""select f.run_key, f.path as file, case when (f.path like '%.yml' or f.path like '%.yaml') and m.path is not null then m.path else f.path end as primary_file
        from v_files f left join (select c.run_key, n.path from case_tests c join tested t on t.run_key = c.run_key and t.id = c.test_id and t.n = 1
          join v_nodes n on n.run_key = t.run_key and n.id = t.model_id) m on m.run_key = f.run_key""",
)
def primary_files(i: Inputs) -> DataFrame:
    tests = lineage.find_tests(errors.failing_tests(sliced(i)), i.v_nodes)
    tested = lineage.tested_models(i.v_nodes, i.v_deps)
    cases = i.v_files.select("run_key", F.col("path").alias("file"))
    return C.primary_files(cases, tests, tested, i.v_nodes).withColumnRenamed("primary", "primary_file")


@query("test_cards", ctes=f"{TESTED},{CARDS}", sql="select run_key, test_id, text from cards")
def test_cards(i: Inputs) -> DataFrame:
    return C.test_cards(_all_tests(i), nodes(i), lineage.tested_models(i.v_nodes, i.v_deps))


@query(
    "test_signals",
    ctes=f"{TESTED},{CARDS},{ALL_TESTS},{test_signal_sql('all_tests')}",
    sql="select run_key, signal from test_sig",
)
def test_signals(i: Inputs) -> DataFrame:
    return C.test_signals(_all_tests(i), nodes(i), lineage.tested_models(i.v_nodes, i.v_deps))


@query(
    "related_test_models",
    ctes=f"{PROFILES},{TESTED},{FAILING}",
    sql=f"""select p.run_key, p.id as root_id, 'test_model_' || cast(t.n as varchar) as key, {_block('RELATED_TEST_MODEL', 'm.name', 'm.path', '1', 'm.text')} as text
        from profiles p join case_tests c on c.run_key = p.run_key join tested t on t.run_key = c.run_key and t.id = c.test_id and t.model_id <> p.id
        join profiles m on m.run_key = t.run_key and m.id = t.model_id""",
)
def related_test_models(i: Inputs) -> DataFrame:
    found = stage(profiles(i).select("run_key", "id", "name", "path", "text"), "profiles")
    tests = lineage.find_tests(errors.failing_tests(sliced(i)), i.v_nodes)
    related = C.related_tests(_all_roots(found), tests, lineage.tested_models(i.v_nodes, i.v_deps), found)
    none = found.select("run_key", F.col("id").alias("root_id"), F.array(F.lit("")).alias("signals"))
    return C.test_model_sections(related, none).select("run_key", "root_id", "key", "text")


@query(
    "macro_contexts",
    ctes=f"{PROFILES},{ALL},{macro_sql('every')}",
    sql="select run_key, root_id, 'macro_' || cast(n as varchar) as key, text from macro_blocks",
)
def macro_contexts(i: Inputs) -> DataFrame:
    found = stage(profiles(i).select("run_key", "id", "text"), "profiles")  # no column that is not used
    picks = C.macro_picks(_all_roots(found), found, i.v_macros, i.v_macro_deps)
    return C.macro_sections(picks, found, i.v_files).select("run_key", "root_id", "key", "text")


@query(
    "definition_contexts",
    ctes=f"{FAILING},{PROFILES},{ALL},{definition_sql('every')}",
    sql="select run_key, root_id, 'definition_' || cast(n as varchar) as key, text from def_blocks",
)
def definition_contexts(i: Inputs) -> DataFrame:
    found = stage(profiles(i).select("run_key", "id"), "profiles")
    none = found.select("run_key", F.col("id").alias("root_id"), F.array(F.lit("")).alias("signals"))
    return C.definition_sections(
        _all_roots(found), sliced(i), none, i.v_nodes, i.v_deps, i.v_sources, i.v_files
    ).select("run_key", "root_id", "key", "text")


_SIGNAL_LINES = """trim(case when len(list_filter(string_split(f.text, chr(10)), lambda l: len(list_filter(q.signals, lambda s: contains(lower(l), s))) > 0)) > 0
  then array_to_string(list_filter(string_split(f.text, chr(10)), lambda l: len(list_filter(q.signals, lambda s: contains(lower(l), s))) > 0), chr(10)) else f.text end, ' ' || chr(10))"""


@query(
    "definition_contexts_shrunk",
    ctes=f"""{FAILING},{PROFILES},
        every as (select e.run_key, e.id as root_id, {D.union(D.refs('text'), "['key_1']")} as signals from profiles e),
        {definition_sql('every', _SIGNAL_LINES.replace('q.signals', 'r.signals'), _SIGNAL_LINES.replace('q.signals', 'r.signals'))}""",
    sql="select run_key, root_id, 'definition_' || cast(n as varchar) as key, text from def_blocks",
)
def definition_contexts_shrunk(i: Inputs) -> DataFrame:
    refs = S.union(S.refs(F.col("text")), F.array(F.lit("key_1"))).alias("signals")
    found = stage(profiles(i).select("run_key", "id", refs), "profiles")
    signals = found.select("run_key", F.col("id").alias("root_id"), "signals")
    return C.definition_sections(
        _all_roots(found), sliced(i), signals, i.v_nodes, i.v_deps, i.v_sources, i.v_files, shrink=True
    ).select("run_key", "root_id", "key", "text")


@query("compiled_blocks", ctes=f"{FAILING},{COMPILED}", sql="select run_key, compiled from compiled")
def compiled_blocks(i: Inputs) -> DataFrame:
    return C.compiled_blocks(sliced(i), i.v_files)


@query(
    "merged_sections",
    sql="""select run_key, dep_id as root_id, any_value(folder) as key, arg_max(id, (pos, id)) as text, count(*) as n from (
        select d.run_key, d.dep_id, d.id, d.pos, n.resource_type as folder from v_deps d join v_nodes n on n.run_key = d.run_key and n.id = d.id) x
        group by run_key, dep_id, folder""",
)
def merged_sections(i: Inputs) -> DataFrame:
    """Sections keyed by resource type, so that keys collide and the last text wins."""
    named = i.v_deps.join(i.v_nodes.select("run_key", "id", "resource_type"), ["run_key", "id"]).select(
        "run_key", F.col("dep_id").alias("root_id"), F.struct("pos", "id").alias("seq"),
        F.col("resource_type").alias("key"), F.col("id").alias("text"),
    )
    counts = named.groupBy("run_key", "root_id", "key").agg(F.count("*").alias("n"))
    return C.merge_sections(named).drop("seq").join(counts, ["run_key", "root_id", "key"])


# the whole assembly, as SQL over the blamed files
_CASES = f"""
cases as (select b.run_key, b.file, p.primary_file, f.text, (select arg_min(n.id, n.pos) from v_nodes n where n.run_key = b.run_key
      and n.resource_type in ('model', 'snapshot', 'seed') and n.path <> ''
      and (n.path = p.primary_file or {D.stem('p.primary_file')} = n.name or {D.stem('p.primary_file')} = {D.stem('n.path')})) as root_id
  from blamed b join (select x.run_key, x.file, case when (x.file like '%.yml' or x.file like '%.yaml') and m.path is not null then m.path else x.file end as primary_file
      from blamed x left join (select c.run_key, n.path from case_tests c join tested t on t.run_key = c.run_key and t.id = c.test_id and t.n = 1
        join v_nodes n on n.run_key = t.run_key and n.id = t.model_id) m on m.run_key = x.run_key) p on p.run_key = b.run_key and p.file = b.file
  join v_files f on f.run_key = b.run_key and f.path = p.primary_file
  where not list_contains(string_split(p.primary_file, '/'), 'target')),
gate as (select run_key, bool_or(regexp_matches(line, '(?i)\\bFailure\\s+in\\s+test\\s+[\\w.$-]+')
    or regexp_matches(line, '(?i)\\b(?:column|field|identifier)\\b|does not exist|ambiguous column|invalid identifier')) as needs from sliced group by 1),
roots as (select distinct c.run_key, c.root_id from cases c join gate g on g.run_key = c.run_key where needs and root_id is not null),
diag as (select distinct c.run_key, c.root_id from cases c join roots r on r.run_key = c.run_key and r.root_id = c.root_id
    where not list_contains(string_split(c.primary_file, '/'), 'macros')),
rsig as (select run_key, root_id, list(distinct signal) as signals from (
    select r.run_key, r.root_id, s.signal from roots r join (select run_key, unnest({D.error_signals('line')}) as signal from sliced
      union all select run_key, signal from test_sig) s on s.run_key = r.run_key
    union all select r.run_key, r.root_id, unnest({D.refs('p.text')}) from roots r join profiles p on p.run_key = r.run_key and p.id = r.root_id) z group by 1, 2)"""


def _renamed(sql: str, tag: str) -> str:
    return re.sub(r"\b(l1|r1|es|l2|d2|walked)\b", lambda m: m.group(1) + tag, sql)


_UP = _renamed(walk_sql("up_edges", 6, "es.score > 0", "rsig"), "_up")
_DOWN = _renamed(walk_sql("down_edges", 5, "true", "rsig"), "_down")
_HEAD = f"""{FAILING},{CLEAN},{BLAME},{PROFILES},{UP},{DOWN},{TESTED},{CARDS},{test_signal_sql('case_tests')},{_CASES},{_UP},{_DOWN}"""


def _assembled(related: str, up: str, down: str) -> str:
    """All sections and the contexts, from the bodies of related test models and of the nodes of both walks."""
    return f"""
sections as (
  select d.run_key, d.root_id, 0 as seq, 'test_failure' as key, c.text from diag d join case_tests t on t.run_key = d.run_key join cards c on c.run_key = t.run_key and c.test_id = t.test_id
  union all select d.run_key, d.root_id, 1000 + t.n, 'test_model_' || cast(t.n as varchar), {_block('RELATED_TEST_MODEL', 'm.name', 'm.path', '1', related)}
    from diag d join case_tests c on c.run_key = d.run_key join tested t on t.run_key = c.run_key and t.id = c.test_id and t.model_id <> d.root_id
    join profiles m on m.run_key = t.run_key and m.id = t.model_id
  union all select w.run_key, w.root_id, 2000 + w.ord, m.name, {_block('UPSTREAM_MODEL', 'm.name', 'm.path', 'w.depth', up)}
    from walked_up w join diag d on d.run_key = w.run_key and d.root_id = w.root_id join profiles m on m.run_key = w.run_key and m.id = w.node_id
  union all select run_key, root_id, 3000 + n, 'macro_' || cast(n as varchar), text from macro_blocks
  union all select run_key, root_id, 4000 + n, 'definition_' || cast(n as varchar), text from def_blocks),
merged as (select run_key, root_id, key, min(seq) as seq, arg_max(text, seq) as text from sections group by 1, 2, 3),
diagnostic as (select run_key, root_id, string_agg(text, chr(10) order by seq) as diagnostic from merged group by 1, 2),
impact as (select w.run_key, w.root_id, string_agg({_block('DOWNSTREAM_MODEL', 'm.name', 'm.path', 'w.depth', down)}, chr(10) order by ord) as impact
  from walked_down w join profiles m on m.run_key = w.run_key and m.id = w.node_id group by 1, 2),
contexts as (select c.run_key, c.file, '<PRIMARY_ERROR_MODEL path="' || primary_file || '">' || chr(10) || 'SOURCE OF ' || primary_file || ':' || chr(10) || text || chr(10) ||
  'FILE DIFF:' || chr(10) || 'NO_DIFF' || chr(10) || coalesce(compiled, '') || chr(10) || '</PRIMARY_ERROR_MODEL>' || chr(10) || chr(10) ||
  '<DIAGNOSTIC_CONTEXT>' || chr(10) || coalesce(nullif(diagnostic, ''), 'NO_DIAGNOSTIC_CONTEXT') || chr(10) || '</DIAGNOSTIC_CONTEXT>' || chr(10) || chr(10) ||
  '<IMPACT_CONTEXT>' || chr(10) || coalesce(nullif(impact, ''), 'NO_IMPACT_CONTEXT') || chr(10) || '</IMPACT_CONTEXT>' as context
  from cases c left join diagnostic d on d.run_key = c.run_key and d.root_id = c.root_id left join impact i on i.run_key = c.run_key and i.root_id = c.root_id
  left join compiled z on z.run_key = c.run_key)"""


WHOLE = f"{_HEAD},{macro_sql('diag')},{definition_sql('diag')},{COMPILED},{_assembled('m.text', 'm.text', 'm.text')}"


def _focus(kind: str, run: str, root: str, node: str) -> str:
    return f"coalesce((select z.focus from focused z where z.doc_key = '{kind}|' || {run} || '|' || {root} || '|' || {node}), '')"


def _shrunk_sql() -> str:
    """The same with every text cut to what the root's signals point at, over the long files."""
    picks, blocks = macro_sql("diag").split("macro_blocks as (")
    blocks = "macro_blocks as (" + blocks.replace("coalesce(f.text, '')", _focus("macro", "t.run_key", "t.root_id", "t.macro_id"))
    lines = _SIGNAL_LINES.replace("q.signals", "r.signals")
    sql = f"""{_HEAD},{picks}
diag_sig as (select d.run_key, d.root_id, coalesce(s.signals, []) as signals from diag d left join rsig s on s.run_key = d.run_key and s.root_id = d.root_id),
shown as (
  select w.kind, w.run_key, w.root_id, w.node_id as id, m.text, case when w.depth > 1 then p.symbols else s.signals end as signals
    from (select 'up' as kind, run_key, root_id, node_id, depth, parent_id from walked_up union all select 'down', run_key, root_id, node_id, depth, parent_id from walked_down) w
    join profiles m on m.run_key = w.run_key and m.id = w.node_id left join profiles p on p.run_key = w.run_key and p.id = w.parent_id
    left join rsig s on s.run_key = w.run_key and s.root_id = w.root_id
  union select 'test', d.run_key, d.root_id, t.model_id, m.text, d.signals from diag_sig d join case_tests c on c.run_key = d.run_key
    join tested t on t.run_key = c.run_key and t.id = c.test_id join profiles m on m.run_key = t.run_key and m.id = t.model_id
  union select 'macro', t.run_key, t.root_id, t.macro_id, f.text, {D.macro_calls('p.text')} from mtop t join v_macros m on m.run_key = t.run_key and m.id = t.macro_id
    join v_files f on f.run_key = m.run_key and f.path = m.path join profiles p on p.run_key = t.run_key and p.id = t.root_id),
fdoc as (select kind || '|' || run_key || '|' || root_id || '|' || id as doc_key, any_value(text) as text, any_value(coalesce(signals, [])) as signals from shown group by 1),
{focus_sql("fdoc").strip()},
{blocks.strip()},{definition_sql('diag_sig', lines, lines)},{COMPILED},
{_assembled(_focus('test', 'd.run_key', 'd.root_id', 't.model_id'), *(_focus(kind, 'w.run_key', 'w.root_id', 'w.node_id') for kind in ('up', 'down')))}"""
    return re.sub(r"\bv_files\b", "v_wide", sql)


def contexts(i: Inputs) -> DataFrame:
    return pipeline.failure_contexts(i.v_log, ledger(i), blamed(i), project(i))


@query("file_contexts", ctes=WHOLE, sql="select run_key, file, context from contexts")
def file_contexts(i: Inputs) -> DataFrame:
    return contexts(i).select("run_key", "file", "context")


@query("shrunk_contexts", ctes=_shrunk_sql(), sql="select run_key, file, context from contexts")
def shrunk_contexts(i: Inputs) -> DataFrame:
    """Whole contexts for a local model, of projects whose SQL files are longer than it may see."""
    wide = replace(project(i), files=i.v_wide)
    return pipeline.failure_contexts(i.v_log, ledger(i), blamed(i), wide, SHRINKING_PROVIDER).select("run_key", "file", "context")


_JOIN_LINE = r"(?s)^.*\n(join [^\n]*)$"
_DIFFED = WHOLE.replace(
    "'FILE DIFF:' || chr(10) || 'NO_DIFF' ||",
    f"""'FILE DIFF:' || chr(10) || case when regexp_matches(text, {D.lit(_JOIN_LINE)}) then
      '-left ' || regexp_extract(text, {D.lit(_JOIN_LINE)}, 1) || chr(10) || '+' || regexp_extract(text, {D.lit(_JOIN_LINE)}, 1) else 'NO_DIFF' end ||""",
)


@query("file_contexts_with_diffs", ctes=_DIFFED, sql="select run_key, file, context from contexts")
def file_contexts_with_diffs(i: Inputs) -> DataFrame:
    """The base commit of every model file has a left join in its last line."""
    base = i.v_files.withColumn("text", F.regexp_replace("text", r"\njoin ([^\n]*)\z", "\nleft join $1"))
    return pipeline.failure_contexts(i.v_log, ledger(i), blamed(i), project(i), base=base).select("run_key", "file", "context")
