"""Queries over answers, outboxes, subscribers, commits and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import changes, outbox
from ..settings import LABELS
from . import duck as D
from .q_logs import IDS, sliced
from .registry import Inputs, query

_BLOCK = r"(?s)<solution>(.*?)</solution>\s*<file>(.*?)</file>"
_NORMAL = D.strip("case when contains({x}, '<think>') then string_split({x}, '</think>')[-1] else {x} end")


def _normal(x: str) -> str:
    return _NORMAL.replace("{x}", x)


def _valid(x: str, paths: str = "paths") -> str:
    bodies = f"list_transform(regexp_extract_all({x}, {D.lit(_BLOCK)}, 1), lambda b: {D.strip('b')})"
    targets = f"list_transform(regexp_extract_all({x}, {D.lit(_BLOCK)}, 2), lambda b: {D.strip('b')})"
    rest = f"regexp_replace(regexp_replace({x}, {D.lit(_BLOCK)}, '', 'g'), '\\s*----\\s*', '', 'g')"
    bad = "lambda b: b = '' or starts_with(b, '```') or starts_with(b, 'diff --git')"
    return (
        f"(starts_with({x}, '<solution>') and len({paths}) > 0 and len({bodies}) > 0 and {D.strip(rest)} = '' "
        f"and len(list_filter({bodies}, {bad})) = 0 and len(list_filter({targets}, lambda t: not list_contains({paths}, t))) = 0)"
    )


PATHS = f"""
asked as (select *, list_transform(regexp_extract_all(context, '(?m)^SOURCE OF\\s+([^:\\n]+):', 1), lambda p: {D.strip('p')}) as paths from v_answers),
spoken as (select *, {_normal('response')} as said1, {_normal('repaired')} as said2, coalesce(paths[1], 'NO_FILE') as first_path from asked),
settled as (select *, {_valid('said1')} as valid1, {_valid('said2')} as valid2 from spoken),
solved as (select *, case when valid1 then said1 when valid2 then said2
    else '<solution>NO_FIX</solution>' || chr(10) || '<file>' || chr(10) || first_path || chr(10) || '</file>' end as solution from settled),
runs as (select run_key, string_agg(solution, chr(10) || '----' || chr(10) order by ord) as solution from solved group by 1),
pieces as (select run_key, idx - 1 as idx, regexp_extract(p, '(?s)<solution>(.*?)</solution>', 1) as content, regexp_extract(p, '(?s)<file>(.*?)</file>', 1) as file
  from (select run_key, unnest(l) as p, generate_subscripts(l, 1) as idx from (select run_key, string_split(solution, '----') as l from runs) a) b
  where regexp_matches(p, '(?s)<solution>.*?</solution>') and regexp_matches(p, '(?s)<file>.*?</file>')),
fixing as (select * from pieces where {D.strip('content')} <> 'NO_FIX')"""

_REPAIR = (
    "'Your previous response did not match the required tags.' || chr(10) || 'Return only one valid block for this exact file path: ' || first_path || chr(10) || chr(10) || "
    "'If the previous response contains full corrected file content, put that content in <solution>.' || chr(10) || 'Otherwise return NO_FIX.' || chr(10) || chr(10) || "
    "'Valid fallback:' || chr(10) || '<solution>NO_FIX</solution>' || chr(10) || '<file>' || chr(10) || first_path || chr(10) || '</file>' || chr(10) || chr(10) || "
    "'Previous response:' || chr(10) || said1 || chr(10)"
)


def _settled(i: Inputs) -> DataFrame:
    return i.v_answers.withColumn("solution", A.final_solution(F.col("context"), F.col("response"), F.col("repaired")))


def _fixing(i: Inputs) -> DataFrame:
    """Fixing parts with the platform, project and time of their conversation."""
    parts = A.fixing_parts(A.solution_parts(_settled(i)))
    number = F.regexp_extract("run_key", "([0-9]+)", 1).cast("bigint")
    return parts.select(
        "*", F.when(number % 2 == 0, "GitLab").otherwise("Github").alias("platform"), F.lit("models").alias("project"),
        F.timestamp_seconds(number * 86461).alias("at"),
    )


_FIXING = """
sent as (select *, case when cast(substr(run_key, 2) as bigint) % 2 = 0 then 'gitlab' else 'github' end as platform,
  strftime(make_timestamp(cast(substr(run_key, 2) as bigint) * 86461 * 1000000), '%Y%m%d_%H%M%S') as stamp from fixing)"""


@query(
    "answer_checks",
    ctes=PATHS,
    sql="select run_key, file, array_to_string(list_distinct(paths), '|') as paths, said1 as spoken, valid1 as valid, valid2 as repaired_valid from settled"
    .replace("list_distinct(paths)", "paths"),
)
def answer_checks(i: Inputs) -> DataFrame:
    context = F.col("context")
    return i.v_answers.select(
        "run_key", "file", F.array_join(A.source_paths(context), "|").alias("paths"), A.normalize(F.col("response")).alias("spoken"),
        A.is_valid(F.col("response"), context).alias("valid"), A.is_valid(F.col("repaired"), context).alias("repaired_valid"),
    )


@query("final_solutions", ctes=PATHS, sql="select run_key, file, solution from solved")
def final_solutions(i: Inputs) -> DataFrame:
    return _settled(i).select("run_key", "file", "solution")


@query("solution_parts", ctes=PATHS, sql="select run_key, content, file, count(*) as n from fixing group by all")
def solution_parts(i: Inputs) -> DataFrame:
    """The check joins the answers of a run first and splits them afterwards."""
    parts = A.fixing_parts(A.solution_parts(_settled(i)))
    return parts.groupBy("run_key", "content", "file").agg(F.count("*").alias("n"))


@query("repair_prompts", ctes=PATHS, sql=f"select run_key, file, 'system' as role, {_REPAIR} as prompt from settled where not valid1")
def repair_prompts(i: Inputs) -> DataFrame:
    made = A.repair_prompts(i.v_answers.select("run_key", "file", "context", "response"))
    return made.select("run_key", "file", F.col("messages")[0]["role"].alias("role"), F.col("messages")[1]["content"].alias("prompt"))


@query(
    "solution_prompts",
    ctes=IDS + ", logs as (select run_key, string_agg(line, chr(10) order by line_no) as log from sliced group by 1)",
    sql="""select s.run_key, s.path as file, '<DBT_ERROR>' || chr(10) || coalesce(log, '') || chr(10) || '</DBT_ERROR>' || chr(10) || chr(10) ||
        '<SOURCE_CONTEXT>' || chr(10) || text || chr(10) || '</SOURCE_CONTEXT>' as prompt from v_files s left join logs l on l.run_key = s.run_key""",
)
def solution_prompts(i: Inputs) -> DataFrame:
    contexts = i.v_files.select("run_key", F.col("path").alias("file"), F.col("text").alias("context"))
    made = A.prompts(contexts, A.log_texts(A.log_blocks(sliced(i), 1000)), "Return the corrected file.")
    return made.select("run_key", "file", F.col("messages")[1]["content"].alias("prompt"))


@query(
    "prompt_parts",
    ctes=IDS + """,
blocks as (select run_key, row_number() over (partition by run_key order by block) as part, text from (
  select run_key, line_no // 1000 as block, string_agg(line, chr(10) order by line_no) as text from sliced group by 1, 2) b)""",
    sql="""select run_key, path as file, 0 as part, '<DBT_ERROR>' || chr(10) as text from v_files
        union all select run_key, null, part, text from blocks
        union all select run_key, path, null, chr(10) || '</DBT_ERROR>' || chr(10) || chr(10) || '<SOURCE_CONTEXT>' || chr(10) || text || chr(10) ||
        '</SOURCE_CONTEXT>' from v_files""",
)
def prompt_parts(i: Inputs) -> DataFrame:
    contexts = i.v_files.select("run_key", F.col("path").alias("file"), F.col("text").alias("context"))
    return A.prompt_parts(contexts, A.log_blocks(sliced(i), 1000))


@query(
    "limited_prompts",
    ctes=PATHS + f""",
firsts as (select run_key, file, 'first' as kind, '<DBT_ERROR>' || chr(10) || coalesce(response, '') || chr(10) || '</DBT_ERROR>' || chr(10) || chr(10) ||
    '<SOURCE_CONTEXT>' || chr(10) || context || chr(10) || '</SOURCE_CONTEXT>' as prompt from settled),
repairs as (select run_key, file, 'repair' as kind, {_REPAIR} as prompt from settled where not valid1)""",
    sql=f"select run_key, file, kind, {D.head_tail('prompt', 600)} as prompt from (select * from firsts union all select * from repairs) p",
)
def limited_prompts(i: Inputs) -> DataFrame:
    """First and repair prompts under a small limit; every answer stands in for its log."""
    logs = i.v_answers.select("run_key", "file", "response")
    asked = i.v_answers.select("run_key", "file", "context").join(logs, ["run_key", "file"])
    first = asked.select("run_key", "file", F.lit("first").alias("kind"), A.messages(F.lit("s"), A.solution_prompt(F.col("response"), F.col("context")), 600).alias("m"))
    mend = A.repair_prompts(asked, 600).select("run_key", "file", F.lit("repair").alias("kind"), F.col("messages").alias("m"))
    return first.unionByName(mend).select("run_key", "file", "kind", F.col("m")[1]["content"].alias("prompt"))


def echo(messages: list[dict[str, str]]) -> str:
    """A stand-in responder: it hands back the user text, so most answers need mending."""
    return messages[-1]["content"]


@query(
    "responder",
    ctes=PATHS,
    sql=f"""select run_key, file, response as response_text, case when not valid1 then {_REPAIR} end as repaired_text,
        case when valid1 then said1 else '<solution>NO_FIX</solution>' || chr(10) || '<file>' || chr(10) || first_path || chr(10) || '</file>' end as solution from settled""",
)
def responder(i: Inputs) -> DataFrame:
    asked = i.v_answers.select(
        "run_key", "file", "context", A.messages(F.lit("Repeat the answer."), F.col("response")).alias("messages")
    )
    return A.answer(asked, echo).select(
        "run_key", "file", F.col("response").alias("response_text"), F.col("repaired").alias("repaired_text"), "solution"
    )


@query(
    "patch_outbox",
    ctes=PATHS + "," + _FIXING,
    sql=f"""select run_key, platform, path, content, '{LABELS.branch_prefix}' || stamp as branch,
        'Edited ' || {D.basename('path')} || ' [Auto PR by {LABELS.tool} ' || stamp || ']' as message from (
          select *, case when starts_with({D.strip('file')}, 'models') then {D.strip('file')} else 'models/' || {D.strip('file')} end as path from sent) s""",
)
def patch_outbox(i: Inputs) -> DataFrame:
    return outbox.patches(_fixing(i)).drop("ord", "idx")


@query(
    "request_outbox",
    ctes=PATHS + "," + _FIXING,
    sql=f"""select run_key, platform, files, 'Auto ' || case when platform = 'gitlab' then 'merge' else 'pull' end || ' request by {LABELS.tool} ' || stamp as title,
        'fix ' || files as body, '{LABELS.branch_prefix}' || stamp as head, '{LABELS.base_branch}' as base
        from (select run_key, platform, stamp, string_agg({D.strip('file')}, ', ' order by idx) as files from sent group by 1, 2, 3) s""",
)
def request_outbox(i: Inputs) -> DataFrame:
    return outbox.requests(_fixing(i))


@query(
    "notifications",
    sql=f"""select cast(commit_id as varchar) as run_key, tid, case when files <> '' then
        replace(replace({D.lit(LABELS.message_with_files)}, 'файлах %s', 'файлах ' || files), ': %s', ': ' || url) else {D.lit(LABELS.message_without_files)} end as text
        from (select commit_id, project, case when platform = 'GitLab' then 'models/a.sql' else '' end as files, 'https://h/' || cast(commit_id as varchar) as url
              from v_commits where status = 'failed') r join v_subscribers s using (project)""",
)
def notifications(i: Inputs) -> DataFrame:
    requests = i.v_commits.filter("status = 'failed'").select(
        F.col("commit_id").cast("string").alias("run_key"), "project",
        F.when(F.col("platform") == "GitLab", "models/a.sql").otherwise("").alias("files"),
        F.concat(F.lit("https://h/"), F.col("commit_id").cast("string")).alias("url"),
    )
    return outbox.notifications(requests, i.v_subscribers)


@query(
    "new_subscribers",
    sql="""select distinct 'p' || cast(o_custkey as varchar) as tid from orders
        where 'p' || cast(o_custkey as varchar) not in (select 'p' || cast(c_custkey as varchar) from customer where c_mktsegment = 'BUILDING')""",
)
def new_subscribers(i: Inputs) -> DataFrame:
    known = i.customer.filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("tid"))
    asking = i.orders.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("tid"))
    return outbox.new_subscribers(asking, known)


@query(
    "ci_triggers",
    sql="""select commit_id, status = 'failed' and starts_with(branch, 'feature/') and (platform <> 'GitLab' or has_log) as reported,
        case when regexp_matches(before_hash, '^0+$') then 'origin/main' else before_hash end as base from v_commits""",
)
def ci_triggers(i: Inputs) -> DataFrame:
    return i.v_commits.select(
        "commit_id", changes.reports_failure(F.col("status"), F.col("branch"), F.col("platform"), F.col("has_log")).alias("reported"),
        changes.diff_base(F.col("before_hash"), F.lit(LABELS.base_branch)).alias("base"),
    )


@query(
    "ci_builds",
    sql="""select o_orderkey as commit_id, coalesce(forced or names = '', true) as full_build,
        case when coalesce(forced, true) then '' else names end as selectors from orders left join (
        select commit_id, bool_or(regexp_matches(path, '^dwh/(macros/|seeds/|snapshots/|dbt_project[.]yml|packages[.]yml)')) as forced,
          coalesce(string_agg(case when regexp_matches(path, '^dwh/models/.*[.]sql$') then '@' || regexp_extract(path, '([^/]+)[.]sql$', 1) end, ' ' order by pos, path), '') as names
        from v_changes where starts_with(path, 'dwh/') group by 1) s on commit_id = o_orderkey""",
)
def ci_builds(i: Inputs) -> DataFrame:
    return changes.builds(i.v_changes, i.v_commits)


_BASES = "bases as (select * from v_base union all select * from v_base2 where run_key not in (select run_key from v_base))"


@query(
    "file_changes",
    ctes=_BASES,
    sql="""select coalesce(h.run_key, b.run_key) as run_key, coalesce(h.path, b.path) as path,
        case when coalesce(h.run_key, b.run_key) not in (select run_key from bases) then 'NO_DIFF' when b.path is null then 'added'
          when h.path is null then 'removed' when h.text = b.text then 'NO_DIFF' else 'changed' end as status
        from v_head h full join bases b on h.run_key = b.run_key and h.path = b.path""",
)
def file_changes(i: Inputs) -> DataFrame:
    return changes.file_changes(i.v_head, changes.base_snapshot(i.v_base, i.v_base2))


_LINES = r"""select run_key, path, unnest(case when l[-1] = '' then l[1:-2] else l end) as line from (
  select run_key, path, string_split(regexp_replace(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) as l from """


@query(
    "line_changes",
    ctes=f"{_BASES}, hl as ({_LINES} v_head) a), bl as ({_LINES} bases) a)",
    sql="""select run_key, path, '+' as sign, line, count(*) as n from (select * from hl except all select * from bl) p
        where run_key in (select run_key from bases) group by all
        union all select run_key, path, '-', line, count(*) from (select * from bl except all select * from hl) m group by all""",
)
def line_changes(i: Inputs) -> DataFrame:
    found = changes.line_changes(i.v_head, changes.base_snapshot(i.v_base, i.v_base2))
    return found.groupBy("run_key", "path", "sign", "line").agg(F.count("*").alias("n"))


# documents as two versions of a file whose lines are numbered: the base lacks every fifth line, the head every seventh,
# and lines of even number are in lower case in the base
_NUMBERED = """
numbered as (select source as run_key, doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from (
  select source, doc_id, case when l[-1] = '' then l[:-2] else l end as l from (
    select source, doc_id, string_split(regexp_replace(text, '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10)) as l from documents) a) b),
olds as (select run_key, doc_id, i, cast(i as varchar) || ':' || case when i % 2 = 0 then lower(line) else line end as line,
  row_number() over (partition by run_key, doc_id order by i) as no from numbered where i % 5 <> 0),
news as (select run_key, doc_id, i, cast(i as varchar) || ':' || line as line, row_number() over (partition by run_key, doc_id order by i) as no from numbered where i % 7 <> 0),
moves as (select run_key, doc_id, i, '-' as sign, no as old_no, null as new_no, line from olds o where not exists (
    select 1 from news n where n.run_key = o.run_key and n.doc_id = o.doc_id and n.i = o.i and n.line = o.line)
  union all select run_key, doc_id, i, '+', null, no, line from news n where not exists (
    select 1 from olds o where n.run_key = o.run_key and n.doc_id = o.doc_id and n.i = o.i and n.line = o.line)),
kept as (select o.run_key, o.doc_id, o.i from olds o join news n on n.run_key = o.run_key and n.doc_id = o.doc_id and n.i = o.i and n.line = o.line),
gaps as (select run_key, doc_id, i, sign, old_no, new_no, line, sum(k) over (partition by run_key, doc_id order by i) as gap from (
  select *, 0 as k from moves union all select run_key, doc_id, i, null, null, null, null, 1 from kept) u)"""


@query(
    "ordered_line_changes",
    ctes=_NUMBERED,
    sql="""select run_key, 'd' || cast(doc_id as varchar) as path, cast(row_number() over (partition by run_key, doc_id order by gap, sign desc, i) - 1 as int) as place,
        sign, cast(old_no as int) as old_no, cast(new_no as int) as new_no, line from gaps where sign is not null""",
)
def ordered_line_changes(i: Inputs) -> DataFrame:
    """Removed and added lines with their numbers, in file order; numbered lines are unique, so there is one right answer."""
    lines = F.transform(T.split_lines(F.col("text")), lambda x, k: F.struct((k + 1).alias("i"), x.alias("line")))

    def version(every: int, shown) -> DataFrame:
        kept = F.filter(lines, lambda x: x["i"] % every != 0)
        text = F.array_join(F.transform(kept, lambda x: F.concat(x["i"].cast("string"), F.lit(":"), shown(x))), "\n")
        return i.documents.select(F.col("source").alias("run_key"), F.concat(F.lit("d"), "doc_id").alias("path"), text.alias("text"))

    base = version(5, lambda x: F.when(x["i"] % 2 == 0, F.lower(x["line"])).otherwise(x["line"]))
    return changes.line_changes(version(7, lambda x: x["line"]), base)


@query(
    "project_settings",
    sql=r"""select run_key, nullif(regexp_extract(text, 'schema:\s*(\S+)', 1), '') as schema_name,
        nullif(regexp_extract(text, 'dbname:\s*(\S+)', 1), '') as dbname, contains(text, 'ci:') as has_ci from v_profiles""",
)
def project_settings(i: Inputs) -> DataFrame:
    return changes.project_settings(i.v_profiles)


_BARE = f"regexp_replace(regexp_replace({D.strip('link')}, '[.]git$', ''), '/+$', '')"


@query(
    "repo_links",
    ctes=rf"""bare as (select s_suppkey, link, {_BARE} as b from v_links),
      parts as (select *, list_filter(string_split(case when starts_with(b, 'git@') then regexp_extract(b, '^[^:]*:(.*)$', 1)
          else regexp_extract(b, '^(?:https?://)?(?:www\.)?[^/\s]+/(.+)$', 1) end, '/'), lambda p: p <> '') as l,
        case when starts_with(b, 'git@') then regexp_extract(b, '^git@([^:]*):', 1) else regexp_extract(b, '^(?:https?://)?([^/\s]+)/(.+)$', 1) end as host,
        case when starts_with(b, 'git@') then regexp_extract(b, '^[^:]*:(.*)$', 1) else regexp_extract(b, '^(?:https?://)?([^/\s]+)/(.+)$', 2) end as p from bare)""",
    sql="""select s_suppkey, case when len(l) >= 2 then array_to_string(l[1:-2], '/') end as namespace, case when len(l) >= 2 then l[-1] end as name,
        case when link = '' then '' when ends_with(link, '.git') then link else rtrim(link, '/') || '.git' end as clone_link,
        case when host <> '' then 'https://' || host || '/api/v4' end as api_base,
        case when host <> '' then replace(replace(replace(trim(p, '/'), '/', '%2F'), ' ', '%20'), '*', '%2A') end as project from parts""",
)
def repo_links(i: Inputs) -> DataFrame:
    link = F.col("link")
    parts, gitlab = T.repo_parts(link), T.gitlab_project(link)
    return i.v_links.select(
        "s_suppkey", parts.getField("namespace").alias("namespace"), parts.getField("name").alias("name"),
        T.clone_link(link).alias("clone_link"), gitlab.getField("api_base").alias("api_base"), gitlab.getField("project").alias("project"),
    )
