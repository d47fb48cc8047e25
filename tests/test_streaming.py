"""Streams give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.streaming import incremental, windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def replayed(spark, tmp_path, parts=4):
    """The events as a stream of several files."""
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(parts):
        batch.where(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


def test_windows(spark, tmp_path):
    batch, stream = replayed(spark, tmp_path)
    count = lambda df: windows.counts_by_window(df, "1 hour", ["event_type"])
    assert drained(count(stream), "complete", tmp_path, "tumbling") == sorted(map(tuple, count(batch).collect()))


def test_late_rows_within_the_watermark_count(spark, tmp_path):
    batch, stream = replayed(spark, tmp_path)
    by_day = lambda df: df.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "n")
    got = dict(drained(by_day(windows.watermarked(stream, late="60 days")), "update", tmp_path, "late"))
    want = {r.start: r.n for r in by_day(batch).collect()}
    assert {k: max(n for s, n in drained_rows if s == k) for k in want for drained_rows in [list(got.items())]} == {k: got[k] for k in want} and set(got) == set(want)


def test_first_seen(spark, tmp_path):
    batch, stream = replayed(spark, tmp_path)
    got = drained(windows.first_seen(windows.watermarked(stream, late="60 days"), ["user_id"]).select("user_id"), "append", tmp_path, "first")
    assert got == sorted(map(tuple, windows.first_seen(batch, ["user_id"]).select("user_id").collect()))


def test_upsert_stream_keeps_the_newest_row(spark, tmp_path):
    batch, stream = replayed(spark, tmp_path)
    path = str(tmp_path / "table")
    q = incremental.upsert_stream(stream.select("user_id", "event_id", "event_type"), path, ["user_id"], "event_id", str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted(map(tuple, incremental.current(spark, path).select("user_id", "event_id", "event_type").collect()))
    want = incremental.newest(batch.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")
    assert got == sorted(map(tuple, want.select("user_id", "event_id", "event_type").collect()))


def test_expiry(spark):
    rows = spark.sql("select * from values (timestamp'2026-01-01 00:00:00'), (timestamp'2026-01-01 05:59:59') as t(loaded_at)")
    assert incremental.fresh(rows, "2026-01-01 06:00:01", 6 * 3600).count() == 1


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda: {r.k: r.v for r in incremental.current(spark, path).collect()}
    batch = lambda rows: spark.createDataFrame(rows, "k long, stamp long, v string")
    assert incremental.current(spark, path) is None and incremental.merge_batch(batch([]), 0, path, ["k"], "stamp", 8) == []
    first = incremental.merge_batch(batch([(k, 1, "a") for k in range(100)] + [(None, 1, "n"), (5, 0, "old")]), 1, path, ["k"], "stamp", 8)
    assert first == list(range(8)) and table() == {**dict.fromkeys(range(100), "a"), None: "n"}
    second = incremental.merge_batch(batch([(7, 2, "b"), (8, 0, "late")]), 2, path, ["k"], "stamp", 8)
    assert 1 <= len(second) <= 2 and table() == {**dict.fromkeys(range(100), "a"), 7: "b", None: "n"}
    assert {f.name for f in (tmp_path / "t" / "v2").glob("bucket=*")} == {f"bucket={b}" for b in second}
    # run again after a failure: from the table before it, to the same result
    assert incremental.merge_batch(batch([(7, 2, "b"), (8, 0, "late")]), 2, path, ["k"], "stamp", 8) == second and table()[7] == "b" and table()[8] == "a"
    for n in range(3, 7):
        incremental.merge_batch(batch([(k, n, f"v{n}") for k in range(100)] + [(None, n, "n")]), n, path, ["k"], "stamp", 8)
    assert table() == {**dict.fromkeys(range(100), "v6"), None: "n"}
    assert {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")} == {"v5", "v6", "_current5", "_current6"}


def test_a_manifest_cut_short_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(1, 1, v)], "k long, stamp long, v string")
    incremental.merge_batch(rows("a"), 1, path, ["k"], "stamp")
    (tmp_path / "t" / "_current2").mkdir()
    assert [r.v for r in incremental.current(spark, path).collect()] == ["a"]


def test_rows_later_than_the_watermark_are_dropped_and_state_is_let_go(spark, tmp_path):
    """Days in order, then, two batches after the watermark has passed it, a row of the first day: its window has left the
    state and stays as it was."""
    days = ["2026-01-01", "2026-01-02", "2026-01-20", "2026-01-20", "2026-01-01", "2026-01-21"]
    for k, day in enumerate(days):
        spark.createDataFrame([(k, f"{day} 10:00:00")], "event_id long, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("event_id long, ts string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = windows.watermarked(stream, late="2 days").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("string").alias("day"), "n")
    q = counts.writeStream.format("memory").queryName("dropped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("dropped").collect())) == [("2026-01-01 00:00:00", 1), ("2026-01-02 00:00:00", 1)]
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1 and max(s["numRowsTotal"] for s in state) <= 3
