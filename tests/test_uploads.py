"""Landing, ledger and results of uploads that are run again, killed half way, or replaced by a later upload."""

import pytest
from pyspark.sql import functions as F

from faultline.sources import commits, logs
from faultline.streaming import ingest

LINE = "run_key string, line_no long, line string"


def day():
    return F.lit("2024-01-01").cast("date")


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "landing"), str(tmp_path / "arrivals")


def lines_of(spark, *rows):
    return spark.createDataFrame([(k, n, t) for k, texts in rows for n, t in enumerate(texts)], LINE)


def land(spark, place, upload, *rows):
    ingest.land_upload(lines_of(spark, *rows), F.lit(upload), day(), *place)


def stored(spark, place):
    return sorted(tuple(r) for r in ingest.uploaded_lines(ingest.read_arrivals(spark, place[1]), place[0]).collect())


def failing_last(df):
    """The same rows, but the task that reaches line 90 dies when others are through."""
    bad = F.when(F.col("line_no") == 90, F.raise_error(F.lit("killed"))).otherwise(F.col("line"))
    return df.repartition(8, "line_no").withColumn("line", bad.cast("string"))


def test_a_landing_that_is_run_again_counts_once(spark, place):
    for _ in range(3):
        land(spark, place, 1, ("a", ["x", "y"]), ("b", ["z"]))
    assert stored(spark, place) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]


def test_a_landing_killed_while_it_writes_leaves_nothing(spark, place):
    rows = ("a", [f"t{n}" for n in range(100)])
    land(spark, place, 1, ("b", ["z"]))
    with pytest.raises(Exception, match="killed"):
        ingest.land_upload(failing_last(lines_of(spark, rows)), F.lit(1), day(), *place)
    assert stored(spark, place) == [("b", 0, "z")]
    land(spark, place, 1, rows)
    assert len(stored(spark, place)) == 101


def test_a_landing_killed_before_it_is_announced_leaves_nothing(spark, place, monkeypatch):
    land(spark, place, 1, ("a", ["old"]))
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            land(spark, place, 2, ("a", ["new"]))
    assert stored(spark, place) == [("a", 0, "old")]
    land(spark, place, 2, ("a", ["new"]))
    land(spark, place, 2, ("a", ["new"]))
    assert stored(spark, place) == [("a", 0, "new")]


def test_the_ledger_takes_an_append_once_whenever_it_fails(spark, tmp_path, monkeypatch):
    bar, path = "=" * 30, str(tmp_path / "ledger")
    ids = lambda *names: logs.run_ids(lines_of(spark, ("r", [f"{bar}|{n}|{bar}" for n in names])))
    logs.append_ledger(ids("a"), path, 1)
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            logs.append_ledger(ids("b", "c"), path, 2)
    assert [r["run_id"] for r in logs.read_ledger(spark, path).collect()] == ["a"]
    for _ in range(2):
        logs.append_ledger(ids("b", "c"), path, 2)
    ledger = logs.read_ledger(spark, path)
    assert sorted((r["run_id"], *r["seq"]) for r in ledger.collect()) == [("a", 1, 0), ("b", 2, 0), ("c", 2, 1)]
    # a retry that finds its own ids in the ledger has nothing to add, and its empty part takes nothing away
    logs.append_ledger(ids("b").limit(0), path, 2)
    assert logs.read_ledger(spark, path).count() == 3


def counted(lines):
    return {"words": lines.groupBy("run_key", "line").agg(F.count("*").alias("n")), "errors": lines.filter("line = 'error'").select("run_key", "line_no")}


def run(spark, place, sink):
    ingest.each_upload(ingest.accepted_uploads(spark, place[1]), place[0], counted, sink, sink + "-checkpoint").awaitTermination()


def results(spark, sink, name):
    rows = ingest.newest_results(spark, sink, name).collect()
    return sorted(tuple(r[c] for c in ("run_key", "upload_id", "line_no" if name == "errors" else "line")) for r in rows)


def test_a_later_upload_replaces_the_results_of_earlier_batches(spark, place, tmp_path):
    sink = str(tmp_path / "sink")
    land(spark, place, 1, ("a", ["error", "x"]), ("b", ["error"]))
    run(spark, place, sink)
    assert results(spark, sink, "errors") == [("a", 1, 0), ("b", 1, 0)]
    # b again without an error: its row goes; a again, but by an older upload: nothing changes
    land(spark, place, 5, ("b", ["fine"]))
    land(spark, place, 0, ("a", ["error", "error", "error"]))
    run(spark, place, sink)
    assert results(spark, sink, "errors") == [("a", 1, 0)]
    assert results(spark, sink, "words") == [("a", 1, "error"), ("a", 1, "x"), ("b", 5, "fine")]
    # the same upload announced once more by a retry
    land(spark, place, 5, ("b", ["fine"]))
    land(spark, place, 6, ("a", ["y"]))
    run(spark, place, sink)
    assert results(spark, sink, "words") == [("a", 6, "y"), ("b", 5, "fine")] and results(spark, sink, "errors") == []
    # the sink equals the batch result of the newest uploads alone
    newest = counted(ingest.uploaded_lines(ingest.read_arrivals(spark, place[1]), place[0]))["words"]
    assert sorted((r["run_key"], r["line"]) for r in newest.collect()) == [(k, t) for k, _, t in results(spark, sink, "words")]
    ingest.compact_results(spark, sink, "words", f"{tmp_path}/plain")
    assert sorted(r["line"] for r in spark.read.parquet(f"{tmp_path}/plain").collect()) == ["fine", "y"]


def test_a_batch_that_fails_half_way_is_run_again(spark, place, tmp_path):
    sink = str(tmp_path / "sink")
    land(spark, place, 1, ("a", ["error"]))
    run(spark, place, sink)
    land(spark, place, 2, ("a", ["x", "error"]))

    def dies(lines):
        return counted(lines) | {"zz_last": lines.select("run_key", F.raise_error(F.lit("killed")).cast("string").alias("c"))}

    with pytest.raises(Exception, match="killed"):
        ingest.each_upload(ingest.accepted_uploads(spark, place[1]), place[0], dies, sink, sink + "-checkpoint").awaitTermination()
    assert results(spark, sink, "errors") == [("a", 1, 0)]  # the batch is not done, so its rows do not count
    run(spark, place, sink)
    assert results(spark, sink, "errors") == [("a", 2, 1)]


def test_ids_leave_the_state_and_stay_unique_in_the_ledger(spark, place, tmp_path):
    bar, ledger, states = "=" * 30, str(tmp_path / "ledger"), []

    def run_day(upload, date, *names):
        lines = lines_of(spark, ("r", [f"{bar}|{n}|{bar}" for n in names]))
        ingest.land_upload(lines, F.lit(upload), F.lit(date).cast("date"), *place)
        stream = ingest.keep_ledger(ingest.recent_run_ids(ingest.landed_lines(spark, place[0]), "7 days"), ledger, str(tmp_path / "checkpoint"))
        stream.awaitTermination()
        states.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])

    run_day(1, "2024-01-01", *(f"old{n}" for n in range(50)))
    run_day(2, "2024-01-03", "old7", "a")  # within the horizon: known from the state
    run_day(3, "2024-03-01", "b")
    run_day(4, "2024-03-02", "c")
    run_day(5, "2024-03-03", "old7", "old8", "d")  # forgotten by the state, refused by the ledger
    assert max(states) >= 51 and states[-1] < 10
    ids = [r["run_id"] for r in logs.read_ledger(spark, ledger).collect()]
    assert sorted(ids) == sorted([f"old{n}" for n in range(50)] + ["a", "b", "c", "d"])
