"""Inputs of the registered queries, derived from the driver's tables.

Each view is one SELECT that both engines read alike, so a query and its check start from
equal rows.  Views may use the views above them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NL = "chr(10)"

VIEWS: dict[str, str] = {
    # events as the logs of jobs: one job per user, one line per event
    "v_log": f"""
        select run_key, line_no,
          case event_type
            when 'signup' then repeat('=', 30) || ' build | e' || id || ' ' || repeat('=', 30)
            when 'click' then '   '
            when 'purchase' then 'column "k_' || k || '" does not exist in ref(''m_' || k || ''')'
            when 'view' then 'compiled code at target/compiled/app/models/core/part_' || k || '.sql at line ' || id
            else case event_id % 8
              when 0 then chr(27) || '[31mDatabase Error in model m_' || k || ' (models/core/part_' || k || '.sql)' || chr(27) || '[0m'
              when 1 then 'Compilation Error in sql model m_' || k
              when 2 then '  Failure in test unique_m_' || k || '_key (models/core/_core.yml)'
              when 3 then '3 of 9 ERROR creating sql table model main.m_' || k || ' [ERROR in 0.1s]'
              when 4 then 'Runtime error happened in the m_' || k || ' model during the run'
              when 5 then 'Parsing Error in macro cents_' || k || ' (C:/work/macros/cents_' || k || '.sql)'
              when 6 then 'Failure in test accepted_part_' || k || '_range (tests/generic/range.yml)'
              else 'Database Error in snapshot part_' || k || '.'
            end
          end as line
        from (
          select 'r' || cast(user_id as string) as run_key, event_id as line_no, event_id, event_type,
                 cast(event_id as string) as id, regexp_extract(props, '([0-9]+)', 1) as k
          from events) e""",
    # the same logs as uploads: lines of even number first; jobs of even number send those of odd number later
    "v_uploads": """
        select run_key, line_no, line, line_no % 2 as upload_id from v_log
        where line_no % 2 = 0 or cast(substring(run_key, 2) as bigint) % 2 = 0""",
    "v_newest": """
        select u.run_key, u.line_no, u.line from v_uploads u
        join (select run_key, max(upload_id) as upload_id from v_uploads group by run_key) m on m.run_key = u.run_key and m.upload_id = u.upload_id""",
    # every distinct (supplier, part) is one model of the supplier's project
    "v_lag": """
        select sk, pk,
          lag(pk, 1) over (partition by sk, folder order by pk) as p1,
          lag(pk, 2) over (partition by sk, folder order by pk) as p2,
          lag(pk, 4) over (partition by sk, folder order by pk) as p4
        from (select distinct l_suppkey as sk, l_partkey as pk, cast(floor(l_partkey / 500) as bigint) as folder
              from lineitem) d""",
    "v_model": """
        select 'r' || cast(sk as string) as run_key, pk, p1, p2, p4, p_size, p_type,
          cast(pk as string) as ps, cast(pk % 100 as string) as k, cast(coalesce(p1, pk) % 100 as string) as k1,
          cast(p_size as string) as size_text, lower(replace(p_brand, '#', '_')) as brand,
          lower(replace(p_name, ' ', '_')) as words,
          case p_type when 'LARGE' then 'snapshot' when 'SMALL' then 'seed' when 'PROMO' then 'analysis' else 'model' end as kind,
          case p_type when 'SMALL' then 'seeds' when 'PROMO' then 'analyses' else 'models/' || lower(p_type) end as dir
        from v_lag join part on pk = p_partkey""",
    "v_nodes": """
        select run_key, 2 * pk as pos, 'model.app.part_' || ps as id, kind as resource_type,
          'm_' || k as name, 'a_' || ps as alias, dir || '/part_' || ps || '.sql' as path,
          cast(null as string) as column_name, cast(null as string) as test_kind
        from v_model
        union all
        select run_key, 2 * pk + 1, 'test.app.unique_m_' || k || '_key.' || ps, 'test',
          'unique_m_' || k || '_key', cast(null as string), dir || '/_schema.yml', 'key_' || k,
          case when p_size > 45 then 'unique' else cast(null as string) end
        from v_model where p_size > 30""",
    "v_deps": """
        select run_key, 'model.app.part_' || ps as id, 0 as pos, 'model.app.part_' || cast(p1 as string) as dep_id from v_model where p1 is not null
        union all
        select run_key, 'model.app.part_' || ps, 1, 'model.app.part_' || cast(p2 as string) from v_model where p2 is not null
        union all
        select run_key, 'model.app.part_' || ps, 2, 'model.app.part_' || cast(p4 as string) from v_model where p4 is not null
        union all
        select run_key, 'model.app.part_' || ps, 3, 'source.app.raw.' || brand from v_model
        union all
        select run_key, 'test.app.unique_m_' || k || '_key.' || ps, 0, 'model.app.part_' || cast(p1 as string) from v_model where p_size > 30 and p1 is not null
        union all
        select run_key, 'test.app.unique_m_' || k || '_key.' || ps, 1, 'model.app.part_' || ps from v_model where p_size > 30""",
    "v_child_map": """
        select d.run_key, d.dep_id as id, n.pos as pos, d.id as child_id
        from v_deps d join v_nodes n on n.run_key = d.run_key and n.id = d.id""",
    "v_macros": """
        select distinct run_key, p_size as pos, 'macro.app.cents_' || size_text as id, 'cents_' || size_text as name,
          'macros/cents_' || size_text || '.sql' as path from v_model""",
    "v_macro_deps": """
        select run_key, 'model.app.part_' || ps as id, 0 as pos, 'macro.app.cents_' || cast((p_size * 7) % 50 + 1 as string) as macro_id from v_model
        union all
        select run_key, 'model.app.part_' || ps, 1, 'macro.app.missing_' || k from v_model""",
    "v_sources": """
        select run_key, 'source.app.raw.' || brand as id, brand as name, min(dir) || '/_schema.yml' as path
        from v_model where p_type in ('ECONOMY', 'STANDARD') group by run_key, brand""",
    "v_model_files": f"""
        select run_key, pk, dir || '/part_' || ps || '.sql' as path,
          '{{{{ config(materialized=''table'') }}}}' || {_NL} ||
          'with base_' || size_text || ' as (' || {_NL} ||
          '  select ' || words || ' as col_' || k || ', k_' || k1 || ' from {{{{ ref(''m_' || k1 || ''') }}}}' || {_NL} ||
          ')' || {_NL} ||
          'select {{{{ cents_' || size_text || '(''k_' || k || ''') }}}} as amt_' || size_text || ' from base_' || size_text || {_NL} ||
          'join {{{{ source(''raw'', ''' || brand || ''') }}}} s on s.id = key_' || k as text
        from v_model""",
    "v_files": f"""
        select run_key, path, text from v_model_files
        union all
        select distinct run_key, 'macros/cents_' || size_text || '.sql',
          '{{% macro cents_' || size_text || '(x) %}} ({{{{ x }}}} / 100) {{% endmacro %}}' from v_model
        union all
        select distinct run_key, dir || '/_schema.yml', 'models:' || {_NL} || '  - name: ' || dir || {_NL} || '    description: key_1 ' || dir from v_model
        union all
        select distinct run_key, 'target/compiled/app/models/core/part_' || k || '.sql', 'select k_' || k || ' from m_' || k from v_model""",
    # the projects' files with SQL so long that a local model gets it shortened
    "v_wide": """
        select run_key, path, case when path like '%.sql' and path not like 'target/%'
          then text || repeat(chr(10) || '-- see key_' || cast(length(path) % 7 as string) || ' and m_' || cast(length(text) % 100 as string) || ' for more', 70)
          else text end as text from v_files""",
    # documents as long SQL files: a generated head and tail around the whole text
    "v_long_sql": f"""
        select 'd' || cast(doc_id as string) as doc_key, lang, source,
          '{{{{ config(tags=[''' || lang || ''']) }}}}' || {_NL} ||
          'with src_' || cast(doc_id % 97 as string) || ' as (select * from {{{{ ref(''stg_' || source || ''') }}}} as ' || source || '_rows)' || {_NL} ||
          text || {_NL} ||
          'select {{{{ fmt_' || lang || '(''x'') }}}} as label_' || lang || ', the_key from src_' || cast(doc_id % 97 as string) || {_NL} ||
          'where the_key is not null' as text
        from documents""",
    # conversations as answers: the turn before is the context, the turn itself the answer
    "v_answers": f"""
        select 'c' || cast(conv_id as string) as run_key, 'models/t' || cast(turn as string) || '.sql' as file, turn as ord,
          'SOURCE OF models/t' || cast(turn as string) || '.sql:' || {_NL} || coalesce(said, '') || {_NL} || 'SOURCE OF  macros/c.sql :' as context,
          case (conv_id + turn) % 7
            when 0 then '<solution>' || {_NL} || text || {_NL} || '</solution>' || {_NL} || '<file>' || {_NL} || 'models/t' || cast(turn as string) || '.sql' || {_NL} || '</file>'
            when 1 then '<think>let me see</think>  <solution>' || text || '</solution><file>macros/c.sql</file> '
            when 2 then '<solution>' || text || '</solution><file>macros/c.sql</file>' || {_NL} || '----' || {_NL} || '<solution>NO_FIX</solution> <file>models/t' || cast(turn as string) || '.sql</file>'
            when 3 then 'Maybe this: ' || text
            when 4 then '<solution>' || text || '</solution><file>models/unknown.sql</file>'
            when 5 then '<solution> NO_FIX </solution><file>models/t' || cast(turn as string) || '.sql</file>'
            else '<solution>diff --git ' || text || '</solution><file>macros/c.sql</file>' end as response,
          case when turn % 3 = 0 then '<solution>' || text || '</solution><file>macros/c.sql</file>' else text end as repaired
        from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as said from conversations) t""",
    # orders as commits, their lines as changed paths
    "v_commits": """
        select o_orderkey as commit_id, case o_orderstatus when 'F' then 'failed' when 'O' then 'success' else 'running' end as status,
          case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'feature/x' || o_orderpriority else 'main' end as branch,
          case when o_custkey % 2 = 0 then 'GitLab' else 'Github' end as platform, o_totalprice > 200000 as has_log,
          case when o_orderpriority = '5-LOW' then '0000000' else 'c' || cast(o_custkey as string) end as before_hash,
          o_orderdate as at, 'p' || cast(o_custkey as string) as project
        from orders""",
    "v_changes": """
        select l_orderkey as commit_id, l_linenumber as pos, 'dwh' as project,
          case l_returnflag when 'A' then 'dwh/' when 'R' then 'dwh/' else 'other/' end ||
          case when l_quantity < 2 then 'macros/' when l_quantity < 3 then 'packages.yml' when l_quantity < 8 then 'docs/' else 'models/core/' end ||
          'part_' || cast(l_partkey as string) || case when l_tax < 0.02 then '.yml' else '.sql' end as path
        from lineitem""",
    # documents as two snapshots of a project per source
    "v_head": f"""
        select source as run_key, 'docs/d' || cast(doc_id as string) || '.sql' as path, text || case when lang = 'de' then {_NL} || 'select 1' else '' end as text
        from documents where lang <> 'es'""",
    "v_base": """
        select source as run_key, 'docs/d' || cast(doc_id as string) || '.sql' as path, text from documents where lang <> 'fr' and source <> 'src7'""",
    "v_base2": """
        select source as run_key, 'docs/d' || cast(doc_id as string) || '.sql' as path, lower(text) as text from documents where source in ('src7', 'src8')""",
    # suppliers as repositories, nations as projects with profiles
    "v_links": """
        select s_suppkey, case s_suppkey % 7
          when 0 then 'https://github.com/org' || cast(s_nationkey as string) || '/repo-' || cast(s_suppkey as string) || '.git'
          when 1 then 'git@gitlab.com:grp/sub ' || cast(s_nationkey as string) || '/~r*' || cast(s_suppkey as string) || '.git'
          when 2 then 'www.host.org/a/b' || cast(s_suppkey as string) || '//'
          when 3 then 'https://github.com/only' || cast(s_suppkey as string)
          when 4 then ''
          when 5 then ' http://h/x/y/z' || cast(s_suppkey as string) || '/ '
          else 'nohost' || cast(s_suppkey as string) end as link
        from supplier""",
    "v_profiles": f"""
        select 'p' || cast(c_custkey as string) as run_key,
          case when c_acctbal > 0 then 'dev:' || {_NL} || '  schema: sch_' || lower(c_mktsegment) || {_NL} else '' end ||
          case when c_nationkey > 5 then '  dbname:   db_' || cast(c_nationkey as string) || {_NL} else '' end ||
          case when c_mktsegment = 'BUILDING' then 'ci:' || {_NL} || '  target: ci' else '' end as text
        from customer""",
    "v_subscribers": """
        select 'p' || cast(o_custkey as string) as project, 't' || cast(c_nationkey as string) || '_' || cast(o_custkey as string) as tid
        from (select distinct o_custkey from orders) o join customer on c_custkey = o_custkey""",
    "v_doc_signals": """
        select doc_key, 'label_' || lang as signal from v_long_sql
        union select doc_key, 'tion' from v_long_sql
        union select doc_key, source from v_long_sql
        union select doc_key, 'the_key' from v_long_sql""",
}


# the projects' tables are derived once and written, as a loader would, then shared by the queries
_STAGED = ("v_model", "v_nodes", "v_deps", "v_files", "v_child_map")
_staged: dict[tuple[str, str, str], DataFrame] = {}


def _lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_lag`` with its rows dealt out by project and folder once, for the distinct rows and for the window."""
    rows = view(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), F.floor(F.col("l_partkey") / 500).cast("long").alias("folder")
    )
    models = rows.repartition("sk", "folder").distinct()
    order = Window.partitionBy("sk", "folder").orderBy("pk")
    return models.select("sk", "pk", *[F.lag("pk", n).over(order).alias(f"p{n}") for n in (1, 2, 4)])


_BUILT = {"v_lag": _lag}  # views that are planned here, with the rows of their SELECT


def _staged_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        earlier = tuple(s for s in _STAGED if s != name)
        _staged[key] = stage(_select(spark, sf_dir, name, earlier), name)
    return _staged[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _STAGED:
        return _staged_view(spark, sf_dir, name)
    return _select(spark, sf_dir, name, _STAGED)


def _select(spark: SparkSession, sf_dir: str, name: str, staged: tuple[str, ...]) -> DataFrame:
    ctes = with_clause(name, (*staged, *_BUILT))
    for table in (*TABLES, *staged, *_BUILT):
        if re.search(rf"\bfrom {table}\b|\bjoin {table}\b", ctes):
            made = _BUILT[table](spark, sf_dir) if table in _BUILT else view(spark, sf_dir, table)
            made.createOrReplaceTempView(table)
    return spark.sql(ctes + f" select * from {name}")


def _needed(sql: str, seen: dict[str, str], skip: tuple[str, ...]) -> dict[str, str]:
    for name in VIEWS:
        if name not in seen and name not in skip and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen, skip)
            seen[name] = VIEWS[name]
    return seen


def with_clause(sql: str, skip: tuple[str, ...] = ()) -> str:
    """``WITH`` clause that defines every view which ``sql`` mentions, directly or not."""
    views = _needed(sql, {}, skip)
    return "with " + ", ".join(f"{n} as ({q})" for n, q in views.items())
