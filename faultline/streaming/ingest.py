"""Continuous ingest: landed failure logs in, results of the newest upload and outbox rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stage
from ..sources import commits
from ..sources.logs import append_ledger, is_separator, read_ledger, separator_id

LINES = "run_key string, upload_id long, line_no long, line string, part string, day date"
ARRIVALS = "run_key string, upload_id long, day date, part string"


def upload_key(repo: Column, commit_hash: Column, dbt_path: Column) -> Column:
    """One upload's run key, so that no upload overwrites another."""
    return F.concat_ws("|", repo, commit_hash, dbt_path)


def land_upload(lines: DataFrame, upload_id: Column, day: Column, landing: str, arrivals: str) -> None:
    """Store the lines of uploads by day, then announce them; a later upload of a key has a larger id.

    Lines land in a part of their own, which is announced when it is complete.  A job that is killed leaves a part
    that nobody reads; one that is run again announces a second part for its uploads, of which readers take the first.
    """
    dated = lines.select("run_key", upload_id.cast("long").alias("upload_id"), "line_no", "line", day.alias("day"))
    part = commits.write_part(dated, landing, ("day",))
    stored = lines.sparkSession.read.schema(LINES).parquet(landing).filter(F.col("part") == part)
    commits.publish(stored.select("run_key", "upload_id", "day", "part").distinct(), arrivals)


def read_arrivals(spark: SparkSession, arrivals: str) -> DataFrame:
    """All announced uploads."""
    return commits.published(spark.read.schema(ARRIVALS).parquet(arrivals))


def accepted_uploads(spark: SparkSession, arrivals: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of announced uploads."""
    return commits.published(spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals))


def newest_uploads(batch: DataFrame) -> DataFrame:
    """(run_key, upload_id, day, part) of the newest upload of each key, where it was announced first."""
    order = F.struct("upload_id", (-F.col("published")).alias("early"), "part")
    return batch.groupBy("run_key").agg(F.max_by(F.struct("upload_id", "day", "part"), order).alias("u")).select("run_key", "u.*")


def lines_of(uploads: DataFrame, landing: str) -> DataFrame:
    """(run_key, line_no, line) of the given uploads.

    Their days and parts, a handful of values for each announcement file, become literal filters, so other folders are not scanned.
    """
    spots = uploads.select("day", "part").distinct().collect()
    days, parts = {r["day"] for r in spots}, {r["part"] for r in spots}
    stored = uploads.sparkSession.read.schema(LINES).parquet(landing).filter(F.col("day").isin(*days) & F.col("part").isin(*parts))
    return stored.join(uploads, ["run_key", "upload_id", "day", "part"]).select("run_key", "line_no", "line")


def uploaded_lines(batch: DataFrame, landing: str) -> DataFrame:
    """All lines of the newest upload of each key announced in a batch."""
    return lines_of(newest_uploads(batch), landing)


def landed_lines(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of single log lines, for work that looks at one line at a time."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).parquet(landing)


def distinct_run_ids(lines: DataFrame) -> DataFrame:
    """Each (run_key, run_id) once over the life of the stream, kept in the state store.

    The state grows with the ids, so it belongs on disk (``session.RECOMMENDED``); ``recent_run_ids`` with
    ``keep_ledger`` holds only the newest ones there.
    """
    return (
        lines.filter(is_separator(F.col("line")))
        .select("run_key", separator_id(F.col("line")).alias("run_id"))
        .dropDuplicates(["run_key", "run_id"])
    )


def recent_run_ids(lines: DataFrame, horizon: str) -> DataFrame:
    """(run_key, run_id, line_no, at): ids that no line of the last ``horizon`` (by upload day) had, from ``landed_lines``.

    Ids leave the state once the watermark has passed their day by ``horizon``.  An id that comes again after that is
    given again, which ``keep_ledger`` refuses.
    """
    dated = lines.withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", horizon)
    return (
        dated.filter(is_separator(F.col("line")))
        .select("run_key", separator_id(F.col("line")).alias("run_id"), "line_no", "at")
        .dropDuplicatesWithinWatermark(["run_key", "run_id"])
    )


def keep_ledger(ids: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of ids to the ledger, each once over the ledger's life; a batch that is run again appends nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy("run_key", "run_id").agg(F.max("line_no").alias("line_no"))
        if batch_id:
            found = found.join(read_ledger(batch.sparkSession, ledger).filter(F.col("seq.batch") < batch_id).select("run_key", "run_id"), ["run_key", "run_id"], "left_anti")
        append_ledger(found, ledger, batch_id)

    return ids.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_available(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a parquet sink, exactly once."""
    return (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def each_batch(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame | dict[str, DataFrame]], sink: str, checkpoint: str,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Run a batch operator on every micro-batch and write its rows, or several tables by name below the sink.

    A batch replaces its own ``batch_id`` folder, so one that is run again after a failure
    leaves no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made = transform(batch)
        for name, rows in (made if isinstance(made, dict) else {"": made}).items():
            columns = [c for c in partition_by if c in rows.columns]
            rows.write.mode("overwrite").partitionBy(*columns).parquet(f"{sink}/{name}/batch_id={batch_id}".replace("//batch_id", "/batch_id"))

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# --- results of the newest upload ------------------------------------------------------

DONE = "run_key string, upload_id long"


def each_upload(
    stream: DataFrame, landing: str, transform: Callable[[DataFrame], dict[str, DataFrame]], sink: str, checkpoint: str
) -> StreamingQuery:
    """Run ``transform(lines)`` on the newest uploads of every micro-batch; their results replace those of older uploads.

    Result rows, tables by name with a ``run_key`` each, are written under the upload that they come from, and the uploads themselves last, as
    one row for each key, also for a key without any result.  ``newest_results`` reads the rows of each key's newest upload only.
    Uploads that are not newer than what an earlier batch has done are left out; a batch that is run again replaces its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        uploads = newest_uploads(batch)
        if batch_id:
            done = spark.read.schema(f"{DONE}, batch_id long").parquet(f"{sink}/uploads").filter(F.col("batch_id") < batch_id)
            latest = done.groupBy("run_key").agg(F.max("upload_id").alias("latest"))
            uploads = uploads.join(latest, "run_key", "left").filter("latest is null or upload_id > latest").drop("latest")
        uploads = stage(uploads, "uploads")
        version = uploads.select("run_key", "upload_id")
        for name, rows in transform(lines_of(uploads, landing)).items():
            rows.join(version, "run_key").write.mode("overwrite").parquet(f"{sink}/{name}/batch_id={batch_id}")
        version.write.mode("overwrite").parquet(f"{sink}/uploads/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest_results(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """Rows of table ``name`` that come from each key's newest upload, with its ``upload_id``."""
    done = spark.read.schema(f"{DONE}, batch_id long").parquet(f"{sink}/uploads")
    newest = done.groupBy("run_key").agg(F.max(F.struct("upload_id", "batch_id")).alias("u")).select("run_key", "u.*")
    return spark.read.parquet(f"{sink}/{name}").join(newest, ["run_key", "upload_id", "batch_id"]).drop("batch_id")


def compact_results(spark: SparkSession, sink: str, name: str, path: str) -> None:
    """Write the newest results of table ``name`` to ``path`` as a plain table, without what later uploads replaced."""
    newest_results(spark, sink, name).write.mode("overwrite").parquet(path)
