"""Queries through the readers, the ledger and the streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..functions import text as T
from ..operators import errors, mentions, outbox, pipeline
from ..session import work_dir
from ..settings import LABELS
from ..sources import files, logs, manifest
from ..streaming import ingest
from . import duck as D
from .q_answers import _FIXING, PATHS
from .q_context import WHOLE, project
from .q_logs import BLAME, BLAMED, CLEAN, IDS, mentions_sql
from .registry import Inputs, query

# --- files -----------------------------------------------------------------------------

def _written_documents(i: Inputs, purpose: str) -> str:
    """Documents as text files, a thousand document numbers of one source per file."""
    path = work_dir(i.spark, purpose)
    shelf = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    rows = i.documents.select(shelf.alias("run_key"), "text")
    rows.repartition("run_key").write.partitionBy("run_key").text(path)
    return path


@query(
    "log_scan",
    sql=r"""select run_key, line, count(*) as n, (select cast(sum(len(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)))) as bigint)
          from documents d where d.source || '-' || cast(floor(doc_id / 1000) as bigint) = l.run_key) - 1 as last_line from (
        select source || '-' || cast(floor(doc_id / 1000) as bigint) as run_key,
          unnest(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10))) as line from documents) l group by 1, 2""",
)
def log_scan(i: Inputs) -> DataFrame:
    lines = logs.read_logs(i.spark, _written_documents(i, "log-files"), r"run_key=([^/]+)/[^/]+\z")
    ends = lines.groupBy("run_key").agg(F.max("line_no").alias("last_line"))
    return lines.groupBy("run_key", "line").agg(F.count("*").alias("n")).join(ends, "run_key")


@query(
    "project_file_scan",
    sql="""select source || '-' || cast(floor(doc_id / 1000) as bigint) as run_key, sum(length(text) + 1) as n_chars from documents group by 1""",
)
def project_file_scan(i: Inputs) -> DataFrame:
    found = files.read_project_files(i.spark, _written_documents(i, "project-files"), "*.txt")
    return found.groupBy(F.regexp_replace("run_key", "run_key=", "").alias("run_key")).agg(F.sum(F.length("text")).alias("n_chars"))


# --- manifests -------------------------------------------------------------------------

def _manifests(i: Inputs, whole_projects: bool = False) -> DataFrame:
    """One JSON manifest per project and folder; a folder holds 500 part numbers at most.

    With ``whole_projects`` one per project, whose ids are led by their folder and a slash.
    """
    nested = F.concat(F.lit('["a_'), F.col("column_name"), F.lit('", 0]'))
    node = F.struct(
        "pos", "resource_type", "name", "alias", F.col("path").alias("original_file_path"), "column_name",
        F.when(
            F.col("resource_type") == "test",
            F.struct(F.col("test_kind").alias("name"), F.create_map(F.lit("column_name"), "column_name", F.lit("values"), nested).alias("kwargs")),
        ).alias("test_metadata"),
    )
    known = F.col("run_key").isNotNull() & F.col("id").isNotNull()  # what has no key belongs to no node
    nodes = i.v_nodes.select("run_key", "id", node.alias("node"))
    deps = i.v_deps.filter(known).select("run_key", "id", F.struct("pos", "dep_id").alias("dep"))
    macros = i.v_macro_deps.filter(known).select("run_key", "id", F.struct("pos", "macro_id").alias("macro"))
    # a node and its edges meet, and then its manifest, where its project's rows lie: they are shuffled once
    tasks = max(int(i.spark.conf.get("spark.sql.shuffle.partitions")), 1 + i.v_nodes.count() // 200_000)
    rows = nodes.unionByName(deps, allowMissingColumns=True).unionByName(macros, allowMissingColumns=True).repartition(tasks, "run_key")
    listed = lambda c, field: F.array_sort(F.collect_list(c)).getField(field)
    rows = rows.groupBy("run_key", "id").agg(F.collect_list("node").alias("nodes"), listed("dep", "dep_id").alias("deps"), listed("macro", "macro_id").alias("macros"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    depends_on = F.struct(some("deps").alias("nodes"), some("macros").alias("macros")).alias("depends_on")
    rows = rows.select("run_key", "id", F.explode("nodes").alias("node"), depends_on)
    folder = F.floor(F.col("node.pos") / 1000).cast("string")
    key = F.concat(T.blank_if_null(folder), F.lit("/"), "id") if whole_projects else F.col("id")
    fields = [F.col(f"node.{c}").alias(c) for c in ("resource_type", "name", "alias", "original_file_path", "column_name", "test_metadata")]
    entry = F.struct(key.alias("key"), F.struct(*fields, "depends_on").alias("value")).alias("entry")
    rows = rows.select("run_key", folder.alias("folder"), F.struct(F.col("node.pos").alias("pos"), entry).alias("e"))
    # the JSON keeps the order of the sorted entries
    entries = F.array_sort(F.collect_list("e"), lambda a, b: (a["pos"] - b["pos"]).cast("int")).getField("entry")
    made = rows.groupBy("run_key", *([] if whole_projects else ["folder"])).agg(F.to_json(F.struct(F.map_from_entries(entries).alias("nodes"))).alias("json"))
    return made if whole_projects else made.select(F.concat_ws("_", "run_key", "folder").alias("run_key"), "json")


FILES_PER_TASK = 500


def _write_files(made: DataFrame, files: int, path: str) -> None:
    """A file per key.  Tasks go by the number of files, not by their bytes, and put them in place themselves.

    The default commit moves every file once more, one by one in the driver.  The folder is fresh and read after the write
    only, and a task that is run again writes the same names, so nothing half done can be read.
    """
    tasks = max(made.sparkSession.sparkContext.defaultParallelism, 1 + files // FILES_PER_TASK)
    writer = made.repartition(tasks, "run_key").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("run_key").text(path)


_NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a key
_FOLDER = "run_key || '_' || cast(cast(floor(pos / 1000) as bigint) as varchar)"


_NODES = f"""select {_FOLDER} as run_key, row_number() over (partition by {_FOLDER} order by pos) - 1 as pos, id, resource_type, name,
        coalesce(alias, '') as alias, path, coalesce(column_name, '') as column_name, coalesce(test_kind, '') as test_kind,
        case when resource_type = 'test' then 'column_name=' || column_name || ';values=["a_' || column_name || '", 0]' end as kwargs from v_nodes"""


def _node_rows(manifests: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("kwargs", lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return manifest.nodes(manifests).withColumn("kwargs", shown).drop("metadata")


@query("manifest_nodes", sql=_NODES)
def manifest_nodes(i: Inputs) -> DataFrame:
    return _node_rows(manifest.parse_manifests(_manifests(i)))


@query("manifest_slices", sql=_NODES)
def manifest_slices(i: Inputs) -> DataFrame:
    """The same nodes by way of files that are read entry by entry, whatever their size.

    A file holds a whole project, as making, listing and opening a file per folder takes longer than reading it.
    """
    path = work_dir(i.spark, "manifest-slices")
    made = _manifests(i, whole_projects=True).select("run_key", "json")
    _write_files(made, i.v_nodes.select("run_key").distinct().count(), path)
    found = _node_rows(manifest.read_manifests(i.spark, path, r"run_key=([^/]+)/[^/]+\z", "*.txt", value_bytes=0))
    project, folder = F.nullif("run_key", F.lit(_NO_KEY)), F.nullif(F.substring_index("id", "/", 1), F.lit(""))
    rows = found.withColumn("run_key", F.concat_ws("_", project, folder)).withColumn("id", F.regexp_replace("id", r"\A[^/]*/", ""))
    # a folder's nodes stand together in the file
    return rows.withColumn("pos", F.col("pos") - F.min("pos").over(Window.partitionBy("run_key")))


def _written_manifests(i: Inputs) -> str:
    """A manifest file per project with macros and sources; one more file is no JSON."""
    path = work_dir(i.spark, "manifest-files")
    entry = lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("name", F.col("path").alias("original_file_path"))))))
    macros = i.v_macros.groupBy("run_key").agg(entry().alias("macros"))
    sources = i.v_sources.groupBy("run_key").agg(entry().alias("sources"))
    made = macros.join(sources, "run_key", "full").select("run_key", F.to_json(F.struct("macros", "sources")).alias("json"))
    broken = i.spark.range(1).select(F.lit("broken").alias("run_key"), F.lit('{"macros": {"m": {"name": ').alias("json"))
    _write_files(made.union(broken), made.count(), path)
    return path


@query(
    "manifest_entries",
    sql="""select run_key, 'macros' as part, id, name, path from v_macros union all select run_key, 'sources', id, name, path from v_sources""",
)
def manifest_entries(i: Inputs) -> DataFrame:
    """Macros and sources by way of manifest files."""
    found = manifest.read_manifests(i.spark, _written_manifests(i), r"run_key=([^/]+)/[^/]+\z", "*.txt")
    rows = [manifest.named_entries(found, part).withColumn("part", F.lit(part)) for part in ("macros", "sources")]
    return rows[0].unionByName(rows[1]).select("run_key", "part", "id", "name", "path")


@query(
    "manifest_deps",
    sql="""select n.run_key || '_' || cast(cast(floor(n.pos / 1000) as bigint) as varchar) as run_key, d.id,
        row_number() over (partition by d.run_key, d.id order by d.pos) - 1 as pos, d.dep_id
        from v_deps d join v_nodes n on n.run_key = d.run_key and n.id = d.id""",
)
def manifest_deps(i: Inputs) -> DataFrame:
    return manifest.deps(manifest.parse_manifests(_manifests(i)))


# --- ledger ----------------------------------------------------------------------------

@query(
    "run_ledger",
    ctes=IDS + ", opening as (select run_key, arg_min(run_id, line_no) as run_id, min(line_no) as line_no from ids group by 1)",
    sql="""select run_key, run_id, 1 as batch, line_no from opening
        union all select run_key, run_id, 2, max(line_no) from ids where (run_key, run_id) not in (select run_key, run_id from opening) group by 1, 2""",
)
def run_ledger(i: Inputs) -> DataFrame:
    """Append the first id of every job, then those of the whole log: each id once, in two appends."""
    path = work_dir(i.spark, "ledger")
    empty = i.v_log.sparkSession.createDataFrame([], "run_key string, run_id string")
    opening = logs.run_ids(i.v_log).groupBy("run_key").agg(F.min_by(F.struct("run_id", "line_no"), "line_no").alias("first"))
    logs.append_ledger(opening.select("run_key", "first.*").join(empty, ["run_key", "run_id"], "left_anti"), path, 1)
    for _ in range(2):  # the second append is run again, as after a failure
        logs.append_ledger(logs.new_run_ids(i.v_log, logs.read_ledger(i.spark, path)), path, 2)
    return logs.read_ledger(i.spark, path).select("run_key", "run_id", "seq.batch", "seq.line_no")


_TWICE = f"""
parts as (select run_key, line, line_no % 2 as upload_id, line_no + case when line_no % 2 = 0 then 1000000000 else 0 end as line_no from v_log),
part_ids as (select run_key, upload_id, line_no, {D.strip("replace(string_split(line, '|')[2], '=', '')")} as run_id from parts
  where contains(line, repeat('=', 30)) and contains(line, '|')),
last_ids as (select run_key, arg_max(run_id, (upload_id, line_no)) as run_id from part_ids group by 1),
newest as (select p.* from parts p join (select run_key, max(upload_id) as upload_id from parts group by 1) m
  on m.run_key = p.run_key and m.upload_id = p.upload_id),
begins as (select n.run_key, min(line_no) as start_line from newest n join last_ids l on l.run_key = n.run_key where contains(line, run_id) group by 1)"""


@query(
    "second_upload",
    ctes=_TWICE,
    sql=f"""select n.run_key, line_no, {D.strip('line')} as line from newest n join begins b on b.run_key = n.run_key
        where line_no >= start_line and {D.strip('line')} <> ''""",
)
def second_upload(i: Inputs) -> DataFrame:
    """Each job's log comes in two uploads of one day, landed twice each; the second one's lines have smaller numbers."""
    base = work_dir(i.spark, "uploads")
    landing, arrivals, ledger = f"{base}/landing", f"{base}/arrivals", f"{base}/ledger"
    known = i.spark.createDataFrame([], "run_key string, run_id string")
    for upload in (0, 1):
        lines = i.v_log.filter(F.col("line_no") % 2 == upload).withColumn("line_no", F.col("line_no") + (1_000_000_000 if upload == 0 else 0))
        for _ in range(2):  # every upload is landed again, as after a failure
            ingest.land_upload(lines, F.lit(upload), F.lit("2024-01-01").cast("date"), landing, arrivals)
        logs.append_ledger(logs.new_run_ids(lines, known), ledger, upload)
        known = logs.read_ledger(i.spark, ledger)
    stored = ingest.uploaded_lines(ingest.read_arrivals(i.spark, arrivals), landing)
    return logs.latest_slice(stored, known)


# --- streams ---------------------------------------------------------------------------

def _landed(i: Inputs) -> tuple[str, str, str]:
    base = work_dir(i.spark, "stream")
    landing, arrivals = f"{base}/landing", f"{base}/arrivals"
    ingest.land_upload(i.v_log, F.lit(1), F.lit("2024-01-01").cast("date"), landing, arrivals)
    return base, landing, arrivals


@query("stream_run_ids", ctes=IDS, sql="select distinct run_key, run_id from ids")
def stream_run_ids(i: Inputs) -> DataFrame:
    """Land everything twice with one checkpoint: the state store lets each id through once."""
    base, landing, arrivals = _landed(i)
    for _ in range(2):
        ids = ingest.distinct_run_ids(ingest.landed_lines(i.spark, landing))
        ingest.append_available(ids, f"{base}/ids", f"{base}/ids-checkpoint").awaitTermination()
        if _ == 0:
            ingest.land_upload(i.v_log, F.lit(2), F.lit("2024-01-02").cast("date"), landing, arrivals)
    return i.spark.read.parquet(f"{base}/ids")


@query("stream_ledger", ctes=IDS, sql="select run_key, run_id, count(*) as n from (select distinct run_key, run_id from ids) d group by 1, 2")
def stream_ledger(i: Inputs) -> DataFrame:
    """The same log lands on three days far apart: the state forgets its ids in between, the ledger holds each once."""
    base = work_dir(i.spark, "stream")
    landing, arrivals = f"{base}/landing", f"{base}/arrivals"
    for upload, day in enumerate(("2024-01-01", "2024-03-01", "2024-06-01")):
        ingest.land_upload(i.v_log, F.lit(upload), F.lit(day).cast("date"), landing, arrivals)
        ids = ingest.recent_run_ids(ingest.landed_lines(i.spark, landing), "7 days")
        ingest.keep_ledger(ids, f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return logs.read_ledger(i.spark, f"{base}/ledger").groupBy("run_key", "run_id").agg(F.count("*").alias("n"))


@query(
    "stream_mentions",
    ctes=f"{CLEAN}, whole as (select run_key, line as t from clean), found as ({mentions_sql('whole', 'run_key')})",
    sql="select run_key, pattern, count(*) as n from found group by 1, 2",
)
def stream_mentions(i: Inputs) -> DataFrame:
    base, landing, arrivals = _landed(i)

    def extract(batch: DataFrame) -> DataFrame:
        found = mentions.mentions(ingest.uploaded_lines(batch, landing))
        return found.groupBy("run_key", "pattern").agg(F.count("*").alias("n"))

    uploads = ingest.accepted_uploads(i.spark, arrivals)
    ingest.each_batch(uploads, extract, f"{base}/mentions", f"{base}/mentions-checkpoint").awaitTermination()
    return i.spark.read.parquet(f"{base}/mentions").select("run_key", "pattern", "n")


def _of_newest(sql: str) -> str:
    """Check SQL over the newest uploads in place of whole logs."""
    return re.sub(r"\bv_log\b", "v_newest", sql)


def _streamed(i: Inputs, name: str, diagnose) -> DataFrame:
    """Results of the newest uploads: two rounds of landing, each landed twice, and one stream over both.

    The first upload's results stand in the sink when the second upload of half of the jobs comes.
    """
    base = work_dir(i.spark, "uploads")
    landing, arrivals = f"{base}/landing", f"{base}/arrivals"
    for upload in (0, 1):
        for _ in range(2):
            ingest.land_upload(i.v_uploads.filter(F.col("upload_id") == upload), F.lit(upload), F.lit("2024-01-01").cast("date"), landing, arrivals)
        uploads = ingest.accepted_uploads(i.spark, arrivals)
        ingest.each_upload(uploads, landing, diagnose, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return ingest.newest_results(i.spark, f"{base}/out", name)


def _ledger_of(lines: DataFrame) -> DataFrame:
    return logs.run_ids(lines).withColumnRenamed("line_no", "seq")


@query("stream_error_files", ctes=_of_newest(f"{IDS},{CLEAN},{BLAME}"), sql=BLAMED)
def stream_error_files(i: Inputs) -> DataFrame:
    """Blamed files, kept up with the uploads."""

    def diagnose(lines: DataFrame) -> dict[str, DataFrame]:
        return {"blamed": errors.error_files(lines, _ledger_of(lines), i.v_nodes, i.v_macros, i.v_deps, i.v_files)}

    order = Window.partitionBy("run_key").orderBy("pattern", "line_no", "idx")
    return _streamed(i, "blamed", diagnose).withColumn("ord", F.row_number().over(order)).drop("line_no", "idx", "upload_id")


@query("stream_contexts", ctes=_of_newest(WHOLE), sql="select run_key, file, context from contexts")
def stream_contexts(i: Inputs) -> DataFrame:
    """Contexts of the blamed files, kept up with the uploads."""

    def diagnose(lines: DataFrame) -> dict[str, DataFrame]:
        ledger = _ledger_of(lines)
        return {"contexts": pipeline.failure_contexts(lines, ledger, pipeline.blamed_files(lines, ledger, project(i)), project(i))}

    return _streamed(i, "contexts", diagnose).select("run_key", "file", "context")


@query(
    "stream_outbox",
    ctes=PATHS + "," + _FIXING + f""",
runs_sent as (select run_key, platform, stamp, string_agg({D.strip('file')}, ', ' order by idx) as files from sent group by 1, 2, 3)""",
    sql=f"""select 'patch' as kind, run_key, platform, case when starts_with({D.strip('file')}, 'models') then {D.strip('file')} else 'models/' || {D.strip('file')} end
          || ': ' || content as detail from sent
        union all select 'request', run_key, platform, files from runs_sent
        union all select 'notification', run_key, null, replace(replace({D.lit(LABELS.message_with_files)}, 'файлах %s', 'файлах ' || files), ': %s',
          ': branch {LABELS.branch_prefix}' || stamp) || ' to t' || t from runs_sent cross join (select unnest([1, 2]) as t) u""",
)
def stream_outbox(i: Inputs) -> DataFrame:
    base = work_dir(i.spark, "outbox")
    i.v_answers.write.parquet(f"{base}/answers")
    stream = i.spark.readStream.schema(i.v_answers.schema).parquet(f"{base}/answers")

    def settle(batch: DataFrame) -> DataFrame:
        solved = batch.withColumn("solution", A.final_solution(F.col("context"), F.col("response"), F.col("repaired")))
        number = F.regexp_extract("run_key", "([0-9]+)", 1).cast("bigint")
        parts = A.fixing_parts(A.solution_parts(solved)).select(
            "*", F.when(number % 2 == 0, "GitLab").otherwise("Github").alias("platform"), F.lit("models").alias("project"),
            F.timestamp_seconds(number * 86461).alias("at"),
        )
        return outbox.outbox_rows(parts, outbox.read_subscribers(i.spark, f"{base}/subscribers"))

    told = i.spark.range(1, 3).select(F.lit("models").alias("project"), F.concat(F.lit("t"), "id").alias("tid"))
    told.write.parquet(f"{base}/subscribers")
    ingest.each_batch(stream, settle, f"{base}/out", f"{base}/checkpoint", ("platform",)).awaitTermination()
    patches, requests, notes = (i.spark.read.parquet(f"{base}/out/{name}") for name in ("patches", "requests", "notifications"))
    none = F.lit(None).cast("string").alias("platform")
    return (
        patches.select(F.lit("patch").alias("kind"), "run_key", "platform", F.concat_ws(": ", "path", "content").alias("detail"))
        .unionByName(requests.select(F.lit("request").alias("kind"), "run_key", "platform", F.col("files").alias("detail")))
        .unionByName(notes.select(F.lit("notification").alias("kind"), "run_key", none, F.concat("text", F.lit(" to "), "tid").alias("detail")))
    )
