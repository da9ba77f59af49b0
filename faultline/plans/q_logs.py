"""Queries over logs: runs, slices, mentions, blamed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import errors, lineage, mentions, resolve
from ..session import stage
from ..sources import logs
from . import duck as D
from .registry import Inputs, query

# --- check SQL shared by the log queries -----------------------------------------------
IDS = f"""
ids as (select run_key, line_no, {D.strip("replace(string_split(line, '|')[2], '=', '')")} as run_id from v_log
        where contains(line, repeat('=', 30)) and contains(line, '|')),
starts as (select l.run_key, min(line_no) as start_line from v_log l
           join (select run_key, arg_max(run_id, line_no) as last_id from ids group by 1) z on z.run_key = l.run_key
           where contains(line, last_id) group by 1),
sliced as (select run_key, line_no, {D.strip('line')} as line from v_log join starts using (run_key)
           where line_no >= start_line and {D.strip('line')} <> '')"""

_ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
CLEAN = f"""
clean as (select run_key, line_no, regexp_replace(line, '{_ANSI}', '', 'g') as line from v_log)"""

_PATTERNS = {
    1: (r"(?i)\b(?:Database|Compilation|Runtime|Parsing)\s+Error\s+in\s+(?:sql\s+)?(model|snapshot|seed|macro)\s+([\w.$-]+)(?:\s+\(([^)\n]+)\))?", 1, 2, 3),
    2: (r"(?i)\bFailure\s+in\s+(model|test|snapshot|seed|macro)\s+([\w.$-]+)(?:\s+\(([^)\n]+)\))?", 1, 2, 3),
    3: (r"(?i)((?:[A-Za-z]:)?/?(?:[\w.@+ -]+/)*(?:models|snapshots|seeds|analyses|macros|tests)/[\w.@+ /-]+\.(?:sql|yml|yaml))", None, None, 1),
    4: (r"(?i)\bERROR\b[^\n]*\bmodel\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)", None, 1, None),
    5: (r"(?i)\berror\b[^\n]{0,200}\b(?:in|for|from)\s+(?:the\s+)?([A-Za-z_][\w$]*)\s+(?:model|macro)\b", None, 1, None),
}


def mentions_sql(table: str, keys: str) -> str:
    """Matches of all patterns over the whole text ``t`` of each row."""
    out = []
    for rank, (pat, *groups) in _PATTERNS.items():
        res, name, path = (f"nullif(regexp_extract(m, {D.lit(pat)}, {g}), '')" if g else "null" for g in groups)
        out.append(
            f"select {keys}, {rank} as pattern, idx, {res} as resource, {name} as name, {path} as path from ("
            f"select {keys}, unnest(l) as m, generate_subscripts(l, 1) as idx from ("
            f"select {keys}, regexp_extract_all(t, {D.lit(pat)}, 0) as l from {table}) a) b"
        )
    return " union all ".join(out)


RESOLVE = f"""
refs as (select distinct run_key, pattern, resource, name, path, coalesce({D.last_part("coalesce(name, '')")}, '') as clean_name,
           {D.source_path("coalesce(path, '')")} as raw_path from found),
by_test as (
  select r.run_key, r.clean_name, arg_min({D.source_path('m.path')}, (t.pos, d.pos)) as tested
  from (select distinct run_key, clean_name from refs where lower(resource) = 'test') r
  join v_nodes t on t.run_key = r.run_key and t.resource_type = 'test'
   and (t.name = clean_name or t.alias = clean_name or contains(t.id, '.' || clean_name || '.') or ends_with(t.id, '.' || clean_name))
  join v_deps d on d.run_key = t.run_key and d.id = t.id
  join v_nodes m on m.run_key = d.run_key and m.id = d.dep_id and m.resource_type in ('model', 'snapshot', 'seed')
  where {D.source_path('m.path')} is not null group by 1, 2),
by_stem as (
  select r.run_key, r.clean_name, arg_min(f.path, (-length({D.stem('f.path')}), f.path)) as inferred
  from (select distinct run_key, clean_name from refs where lower(resource) = 'test') r
  join v_files f on f.run_key = r.run_key and starts_with(f.path, 'models/') and ends_with(f.path, '.sql')
  where contains('_' || clean_name || '_', '_' || {D.stem('f.path')} || '_') group by 1, 2),
by_manifest as (
  select run_key, clean_name, arg_min(path, (tier, pos)) as manifest_raw from (
    select r.run_key, clean_name, n.path, 0 as tier, n.pos from (select distinct run_key, clean_name from refs) r join v_nodes n on n.run_key = r.run_key
      and n.resource_type in ('model', 'snapshot', 'seed', 'macro') and n.path <> '' and clean_name in (n.name, n.alias, {D.stem('n.path')})
    union all
    select r.run_key, clean_name, n.path, 1, n.pos from (select distinct run_key, clean_name from refs) r join v_macros n on n.run_key = r.run_key
      and n.path <> '' and clean_name in (n.name, {D.stem('n.path')})) x
  where clean_name <> '' group by 1, 2),
by_base as (
  select r.run_key, clean_name, arg_min(f.path, string_split(f.path, '/')) as based
  from (select distinct run_key, clean_name from refs where clean_name <> '') r join v_files f on f.run_key = r.run_key
  where {D.basename('f.path')} = clean_name || '.sql' and not list_contains(string_split(f.path, '/'), 'target')
  group by 1, 2),
resolved as (
  select refs.*, case when lower(resource) = 'test'
      then coalesce(tested, inferred, case when ends_with(raw_path, '.sql') or starts_with(raw_path, 'tests/') then raw_path end)
      else coalesce(raw_path, {D.source_path('manifest_raw')}, based) end as file
  from refs left join by_test using (run_key, clean_name) left join by_stem using (run_key, clean_name)
  left join by_manifest using (run_key, clean_name) left join by_base using (run_key, clean_name))"""

BLAME = f"""
texts as (select 'slice' as scope, run_key, string_agg(line, chr(10) order by line_no) as t from (
            select run_key, line_no, regexp_replace(line, '{_ANSI}', '', 'g') as line from sliced) s group by 2
          union all select 'log', run_key, string_agg({D.strip('line')}, chr(10) order by line_no) from clean group by 2),
found as ({mentions_sql("texts", "scope, run_key")}),
{RESOLVE.strip()},
placed as (select f.scope, f.run_key, f.pattern, f.idx, r.resource, r.file,
             case when f.pattern < 3 then 1 when f.pattern = 3 then 2 else 3 end as tier
           from found f join resolved r on r.run_key = f.run_key and r.pattern = f.pattern
            and r.resource is not distinct from f.resource and r.name is not distinct from f.name and r.path is not distinct from f.path),
scoped as (select run_key, scope, case when bool_or(tier = 1 and file is not null) then 1
             when bool_or(lower(resource) = 'test' and file is null) then null else min(case when file is not null then tier end) end as tier
           from placed group by 1, 2),
chosen as (select run_key, scope, tier from scoped where tier is not null
           qualify row_number() over (partition by run_key order by scope desc) = 1),
blamed as (select p.run_key, p.file, p.scope, p.tier, min((p.pattern, p.idx)) as first
           from placed p join chosen c on c.run_key = p.run_key and c.scope = p.scope and c.tier = p.tier
           where file is not null group by 1, 2, 3, 4)"""


def ledger(i: Inputs) -> DataFrame:
    return logs.run_ids(i.v_log).withColumnRenamed("line_no", "seq")


def sliced(i: Inputs) -> DataFrame:
    return logs.latest_slice(i.v_log, ledger(i))


def blamed(i: Inputs) -> DataFrame:
    return errors.error_files(i.v_log, ledger(i), i.v_nodes, i.v_macros, i.v_deps, i.v_files)


BLAMED = """select run_key, file, scope, tier, first[1] as pattern,
        row_number() over (partition by run_key order by first) as ord from blamed"""


@query("error_files", ctes=f"{IDS},{CLEAN},{BLAME}", sql=BLAMED)
def error_files(i: Inputs) -> DataFrame:
    order = Window.partitionBy("run_key").orderBy("pattern", "line_no", "idx")
    return blamed(i).withColumn("ord", F.row_number().over(order)).drop("line_no", "idx")


@query(
    "log_mentions",
    ctes=f"{CLEAN}, whole as (select run_key, line_no, line as t from clean), found as ({mentions_sql('whole', 'run_key, line_no')})",
    sql="select run_key, line_no, pattern, cast(idx - 1 as int) as idx, resource, name, path from found",
)
def log_mentions(i: Inputs) -> DataFrame:
    return mentions.mentions(i.v_log)


@query(
    "log_mentions_across_lines",
    ctes=f"{CLEAN}, whole as (select run_key, string_agg({D.strip('line')}, chr(10) order by line_no) as t from ("
    "select run_key, line_no * 10 + n as line_no, case n when 1 then regexp_extract(line, '^(.*?)( in model| in test| in the|$)(.*)', 1) "
    "else substr(line, 1 + length(regexp_extract(line, '^(.*?)( in model| in test| in the|$)(.*)', 1))) end as line "
    f"from clean cross join (select unnest([1, 2]) as n) q) w group by 1), found as ({mentions_sql('whole', 'run_key')})",
    sql="select run_key, pattern, resource, name, path, count(*) as n from found group by all",
)
def log_mentions_across_lines(i: Inputs) -> DataFrame:
    """The same logs with every reference broken over two lines."""
    clean = T.strip_ansi(F.col("line"))
    head = F.regexp_extract(clean, r"^(.*?)( in model| in test| in the|$)(.*)", 1)
    halves = F.array(head, F.substring(clean, F.length(head) + 1, F.length(clean)))
    broken = i.v_log.select("run_key", "line_no", F.posexplode(halves).alias("n", "part")).select(
        "run_key", (F.col("line_no") * 10 + F.col("n") + 1).alias("line_no"), F.col("part").alias("line")
    )
    found = mentions.mentions(broken, block_lines=1000)
    return found.groupBy("run_key", "pattern", "resource", "name", "path").agg(F.count("*").alias("n"))


@query(
    "run_segments",
    ctes=IDS,
    sql="""select run_key, run_id, count(*) as n_lines, min(line_no) as first_line, max(line_no) as last_line from (
        select l.run_key, l.line_no, last_value(run_id ignore nulls) over (partition by l.run_key order by l.line_no) as run_id
        from v_log l left join ids on ids.run_key = l.run_key and ids.line_no = l.line_no) s group by 1, 2""",
)
def run_segments(i: Inputs) -> DataFrame:
    return logs.segment_runs(i.v_log).groupBy("run_key", "run_id").agg(
        F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


@query(
    "new_run_ids",
    ctes=IDS,
    sql="""select run_key, run_id, max(line_no) as line_no from ids
        where (run_key, run_id) not in (select run_key, arg_min(run_id, line_no) from ids group by 1)
        group by 1, 2""",
)
def new_run_ids(i: Inputs) -> DataFrame:
    """The ledger holds the first id of every job."""
    known = logs.run_ids(i.v_log).groupBy("run_key").agg(F.min_by("run_id", "line_no").alias("run_id"))
    return logs.new_run_ids(i.v_log, known)


@query("latest_slice", ctes=IDS, sql="select run_key, line_no, line from sliced")
def latest_slice(i: Inputs) -> DataFrame:
    return sliced(i)


@query(
    "lineage_gate",
    ctes=IDS,
    sql=r"""select run_key, bool_or(regexp_matches(line, '(?i)\bFailure\s+in\s+test\s+[\w.$-]+')
        or regexp_matches(line, '(?i)\b(?:column|field|identifier)\b|does not exist|ambiguous column|invalid identifier')) as needs_lineage
        from sliced group by 1""",
)
def lineage_gate(i: Inputs) -> DataFrame:
    lines = sliced(i)
    return errors.lineage_gate(lines, errors.failing_tests(lines))


@query(
    "resolved_references",
    ctes=f"{CLEAN}, whole as (select run_key, line as t from clean), found as ({mentions_sql('whole', 'run_key')}), {RESOLVE.strip()}",
    sql="select run_key, pattern, resource, name, path, file from resolved",
)
def resolved_references(i: Inputs) -> DataFrame:
    refs = stage(mentions.mentions(i.v_log).select("run_key", "pattern", "resource", "name", "path").distinct(), "references")
    out = resolve.resolve(refs, i.v_nodes, i.v_macros, i.v_deps, i.v_files)
    return out.select("run_key", "pattern", "resource", "name", "path", "file")


@query(
    "manifest_names",
    ctes="",
    sql=f"""select run_key, name, {D.source_path("arg_min(path, (tier, pos))")} as manifest_path from (
        select run_key, unnest(list_distinct([name, coalesce(alias, ''), {D.stem('path')}])) as name, path, 0 as tier, pos from v_nodes
          where resource_type in ('model', 'snapshot', 'seed', 'macro') and path <> ''
        union all select run_key, unnest(list_distinct([name, {D.stem('path')}])), path, 1, pos from v_macros where path <> '') x
        where name <> '' group by 1, 2""",
)
def manifest_names(i: Inputs) -> DataFrame:
    return resolve.name_index(i.v_nodes, i.v_macros)


@query(
    "file_names",
    sql=f"""select run_key, regexp_replace({D.basename('path')}, '[.]sql$', '') as name,
        arg_min(path, string_split(path, '/')) as file_path from v_files
        where ends_with(path, '.sql') and not list_contains(string_split(path, '/'), 'target')
          and not list_contains(string_split(path, '/'), 'dbt_packages') group by 1, 2""",
)
def file_names(i: Inputs) -> DataFrame:
    return resolve.basename_index(i.v_files)


@query(
    "inferred_from_names",
    sql=f"""select run_key, name, arg_min(path, (-length(stem), path)) as inferred_path from (
        select t.run_key, t.name, f.path, f.stem from (select distinct run_key, 'accepted_' || {D.stem('path')} || '_range_' || name as name
            from v_nodes where resource_type <> 'test') t
        join (select run_key, path, {D.stem('path')} as stem from v_files where starts_with(path, 'models/') and ends_with(path, '.sql')) f
          on f.run_key = t.run_key and contains('_' || t.name || '_', '_' || f.stem || '_')) x group by 1, 2""",
)
def inferred_from_names(i: Inputs) -> DataFrame:
    name = F.concat(F.lit("accepted_"), T.stem(F.col("path")), F.lit("_range_"), F.col("name"))
    tests = i.v_nodes.filter("resource_type <> 'test'").select("run_key", name.alias("name"))
    return resolve.infer_from_names(tests, i.v_files)


@query(
    "compiled_pointers",
    ctes=IDS,
    sql=r"""select run_key, nullif(regexp_extract(t, '(?i)compiled code at\s+(target/[^\s]+\.sql)', 1), '') as path,
        nullif(regexp_extract(t, '\b(?:line|LINE)\s+\d+|\[\d+:\d+\]', 0), '') as location
        from (select run_key, string_agg(line, chr(10) order by line_no) as t from sliced group by 1) s
        where regexp_matches(t, '(?i)compiled code at\s+(target/[^\s]+\.sql)')""",
)
def compiled_pointers(i: Inputs) -> DataFrame:
    return mentions.compiled_mentions(sliced(i))


@query(
    "log_signals",
    ctes=IDS,
    sql=f"""select distinct run_key, unnest({D.error_signals('t')}) as signal from (
        select run_key, string_agg(line, chr(10) order by line_no) as t from sliced group by 1) s""",
)
def log_signals(i: Inputs) -> DataFrame:
    return lineage.log_signals(sliced(i))


_CUT_AT = r"^(.*?(?:compiled code at|[Ll]ine|column|relation|model|table))( .*)$"


_BROKEN = rf"""
broken as (select run_key, string_agg(regexp_replace(line, {D.lit(_CUT_AT)}, '\1' || chr(10) || '\2'), chr(10) order by line_no) as t from sliced group by 1)"""


@query(
    "broken_log_signals",
    ctes=IDS + "," + _BROKEN,
    sql=f"select distinct run_key, unnest({D.error_signals('t')}) as signal from broken",
)
def broken_log_signals(i: Inputs) -> DataFrame:
    """Signals of the same logs with lines broken behind keywords."""
    return lineage.log_signals(_broken(sliced(i)))


@query(
    "broken_compiled_pointers",
    ctes=IDS + "," + _BROKEN,
    sql=r"""select run_key, nullif(regexp_extract(t, '(?i)compiled code at\s+(target/[^\s]+\.sql)', 1), '') as path,
        nullif(regexp_replace(regexp_extract(t, '\b(?:line|LINE)\s+\d+|\[\d+:\d+\]', 0), '\s+', ' ', 'g'), '') as location
        from broken where regexp_matches(t, '(?i)compiled code at\s+(target/[^\s]+\.sql)')""",
)
def broken_compiled_pointers(i: Inputs) -> DataFrame:
    found = mentions.compiled_mentions(_broken(sliced(i)))
    return found.withColumn("location", F.regexp_replace("location", r"\s+", " "))


def _broken(lines: DataFrame) -> DataFrame:
    """Each line cut in two behind its first keyword."""
    first = F.regexp_extract("line", _CUT_AT, 1)
    halves = F.when(first != "", F.array(first, F.regexp_extract("line", _CUT_AT, 2))).otherwise(F.array("line"))
    return lines.select("run_key", "line_no", F.posexplode(halves).alias("n", "line")).select(
        "run_key", (F.col("line_no") * 2 + F.col("n")).alias("line_no"), "line"
    )
