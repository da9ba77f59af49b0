"""Outbox tables: patched files, merge requests, notifications, subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import LABELS, Labels


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def branch_name(at: Column, labels: Labels = LABELS) -> Column:
    return F.concat(F.lit(labels.branch_prefix), _stamp(at))


def patches(parts: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """One row per changed file of ``parts(run_key, ord, idx, content, file, platform, project, at)``."""
    path = T.repo_file_path(F.col("file"), F.col("project"))
    return parts.select(
        "run_key", "ord", "idx", F.lower("platform").alias("platform"), path.alias("path"), "content",
        branch_name(F.col("at"), labels).alias("branch"),
        F.concat(F.lit("Edited "), T.basename(path), F.lit(f" [Auto PR by {labels.tool} "), _stamp(F.col("at")), F.lit("]")).alias("message"),
    )


def requests(parts: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """One merge or pull request per run, listing its files in answer order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "idx", T.strip(F.col("file")).alias("file"))))
    kind = F.when(F.col("platform") == "gitlab", "merge").otherwise("pull")
    return (
        parts.groupBy("run_key", F.lower("platform").alias("platform"), "at")
        .agg(F.array_join(ordered.getField("file"), ", ").alias("files"))
        .select(
            "run_key", "platform", "files",
            F.format_string(f"Auto %s request by {labels.tool} %s", kind, _stamp(F.col("at"))).alias("title"),
            F.concat(F.lit("fix "), "files").alias("body"),
            branch_name(F.col("at"), labels).alias("head"), F.lit(labels.base_branch).alias("base"),
        )
    )


def outbox_rows(parts: DataFrame, subscribers: DataFrame, labels: Labels = LABELS) -> dict[str, DataFrame]:
    """Patches, requests and notifications of one batch of parts; each project's subscribers hear of its requests."""
    asked = requests(parts, labels)
    told = asked.join(parts.select("run_key", "project").distinct(), "run_key").select(
        "run_key", "project", "files", F.concat(F.lit("branch "), "head").alias("url")
    )
    return {"patches": patches(parts, labels), "requests": asked, "notifications": notifications(told, subscribers, labels)}


# --- subscribers -----------------------------------------------------------------------

def new_subscribers(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Ids not subscribed yet, each once; append them to the table."""
    return incoming.select("tid").dropDuplicates(["tid"]).join(known, "tid", "left_anti")


def read_subscribers(spark, path: str) -> DataFrame:
    """The subscriber table (project, tid)."""
    return spark.read.schema("project string, tid string").parquet(path)


def message(files: Column, url: Column, labels: Labels = LABELS) -> Column:
    """Notification text: with files it names them and the request, else only the failure."""
    return F.when(
        T.blank_if_null(files) != "", F.format_string(labels.message_with_files, files, url)
    ).otherwise(F.lit(labels.message_without_files))


def notifications(outgoing: DataFrame, subscribers: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """(run_key, tid, text): each request of a project to each of that project's subscribers.

    Each project has its own subscribers, so project is the join key; the text is built once per
    request, before the fan-out.
    """
    texts = outgoing.select("run_key", "project", message(F.col("files"), F.col("url"), labels).alias("text"))
    return texts.join(subscribers.select("project", "tid"), "project").select("run_key", "tid", "text")
