"""Streams whose state ends, and late rows that are counted."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from termloom.streaming import streams as St


def test_feed_state_ends(spark, tmp_path) -> None:  # noqa: ANN001
    """Twelve batches of ten pairs each, a month apart: what is kept stays as small as after a few of them, and each pair's newest offer is found."""
    folder, sink, state = (f"file://{tmp_path}/{x}" for x in ("offers", "sink", "state"))
    kept, want = [], {}
    for i in range(12):
        day = date(2020, 1, 1) + timedelta(days=30 * i)
        rows = [(f"c{i * 5 + j}", "1", str(day + timedelta(days=j))) for j in range(10)]
        want |= {r[0]: max(r[2], want.get(r[0], "")) for r in rows}
        spark.createDataFrame(rows, "canonical string, version string, date string").coalesce(1).write.mode("append").parquet(folder)
        offers = spark.readStream.schema("canonical string, version string, date string").parquet(folder)
        run = St.for_each_batch(St.stream_feed_select(offers), lambda b: b, sink, state, mode="update")
        run.awaitTermination()
        kept.append(max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]))
    assert max(kept) <= 50 and kept[-1] <= kept[4]  # of 120 pairs and spans in all
    got = {r.canonical: r.date for r in spark.read.parquet(sink).groupBy("canonical").agg(F.max("date").alias("date")).collect()}
    assert got == want


def test_late_rows_over_batches(spark, tmp_path) -> None:  # noqa: ANN001
    """A row is late by the batches before its own; marks of old batches go; an empty table of late rows is a table."""
    folder, sink, marks, state = (f"file://{tmp_path}/{x}" for x in ("events", "sink", "marks", "state"))
    batches = [[("2020-01-01 10:05:00", "a")], [("2020-01-01 09:30:00", "b"), ("2020-01-01 12:30:00", "a")], [("2020-01-01 10:59:00", "c"), ("2020-01-01 12:01:00", "a"), ("2020-01-01 10:01:00", "c")], [("2020-01-01 11:30:00", "a")]]
    for rows in batches:
        spark.createDataFrame(rows, "ts string, code string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        St.stream_late(spark.readStream.schema("ts timestamp, code string").parquet(folder), sink, marks, state).awaitTermination()
    got = sorted((str(r.start), r.code, r.n, r.batch) for r in spark.read.parquet(sink).collect())
    assert got == [("2020-01-01 10:00:00", "c", 2, 2), ("2020-01-01 11:00:00", "a", 1, 3)]
    assert len([p for p in (tmp_path / "marks").iterdir() if p.is_dir()]) == 2
