"""Registered queries for the stream forms: the driver's events as a stream that is read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.driver_views import Views, sql
from termloom.plans.registry import query
from termloom.plans.valueset_queries import Sets
from termloom.streaming import streams as St
from termloom.tables import new_path


def _coded(df: DataFrame) -> DataFrame:
    """event_id, ts, system, code of rows of events."""
    code = F.concat(F.lit("C:"), (F.col("event_id") % 2000).cast("string"))
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("world").alias("system"), code.alias("code"))


def events(v: Views) -> DataFrame:
    """The events table's own rows, as a stream."""
    schema = v.raw("events").schema
    folder = new_path(v.spark, "events")
    v.raw("events").write.parquet(folder)
    return _coded(v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder))


@query("stream_validate", sql("SELECT event_id, 'C:' || (event_id % 2000) IN (SELECT code FROM concepts) AS result FROM events", "concepts"))
def stream_validate(v: Views) -> DataFrame:
    s, sink = Sets(v), new_path(v.spark, "stream")
    St.stream_validate(events(v), lambda _: (s.tables.concepts, s.tables.systems.withColumn("content", F.lit("complete"))), sink, new_path(v.spark, "stream-state")).awaitTermination()
    return v.spark.read.parquet(sink).select("event_id", "result")


@query("stream_translate", "SELECT event_id, coalesce('N:' || c_nationkey, 'B:OTHER') AS target_code FROM events LEFT JOIN customer ON c_custkey = event_id % 2000 AND c_acctbal >= 0")
def stream_translate(v: Views) -> DataFrame:
    """Customers to their nations; those in debt have no element, so the map's rule answers."""
    sink = new_path(v.spark, "stream")
    c = v.raw("customer").filter("c_acctbal >= 0")
    elements = c.select(F.lit("part-brand").alias("map"), F.lit("nations").alias("target"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("code"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("target_code"), F.lit("wider").alias("relationship"), F.lit(False).alias("no_map"))
    St.stream_translate(events(v), lambda _: (elements, v.map_unmapped), "part-brand", sink, new_path(v.spark, "stream-state")).awaitTermination()
    return v.spark.read.parquet(sink).select("event_id", "target_code")


@query("stream_rollup", sql("""
coded AS (SELECT date_trunc('hour', ts) AS start, 'C:' || (event_id % 2000) AS code FROM events),
up AS (SELECT descendant, ancestor FROM closure UNION SELECT code, code FROM coded)
SELECT start, ancestor AS code, count(*) AS n FROM coded JOIN up ON descendant = code GROUP BY ALL""", "closure"))  # fmt: skip
def stream_rollup(v: Views) -> DataFrame:
    """All events, and then a copy of each that comes too late to count, behind one event of a later day that closes their windows."""
    folder, sink, state = new_path(v.spark, "events"), new_path(v.spark, "stream"), new_path(v.spark, "stream-state")
    rows = v.raw("events")
    rows.write.parquet(folder)

    def go_on() -> None:
        stream = _coded(v.spark.readStream.schema(rows.schema).parquet(folder))
        St.for_each_batch(St.stream_rollup(stream, v.closure), lambda b: b, sink, state).awaitTermination()

    go_on()
    last = rows.agg(F.max("ts")).first()[0]
    closing = rows.orderBy("event_id").limit(1).withColumn("ts", F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 2 DAYS"))
    rows.filter(F.col("ts") < F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS")).unionByName(closing).write.mode("append").parquet(folder)
    go_on()
    return v.spark.read.parquet(sink).select(F.col("start").cast("timestamp_ntz").alias("start"), "code", "n")


@query("stream_late_rows", """
SELECT date_trunc('hour', ts) AS start, 'C:' || (event_id % 2000) AS code, count(*) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_late_rows(v: Views) -> DataFrame:
    """All events, and then a copy of each whose window is over: the copies, counted in a table of their own."""
    folder, sink, marks, state = (new_path(v.spark, x) for x in ("events", "stream", "stream-marks", "stream-state"))
    rows = v.raw("events")
    last = rows.agg(F.max("ts")).first()[0]
    for part in (rows, rows.filter(F.col("ts") < F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS"))):
        part.write.mode("append").parquet(folder)
        St.stream_late(_coded(v.spark.readStream.schema(rows.schema).parquet(folder)), sink, marks, state).awaitTermination()
    return v.spark.read.parquet(sink).select(F.col("start").cast("timestamp_ntz").alias("start"), "code", "n")


@query("stream_closure_delta", sql("""
named AS (SELECT code, CASE WHEN module IN ('nation', 'part') THEN 0 WHEN module IN ('orders', 'brand') THEN 1 ELSE 2 END AS batch FROM concepts)
SELECT descendant AS source, ancestor AS target, greatest(a.batch, b.batch) AS batch FROM closure JOIN named a ON a.code = descendant JOIN named b ON b.code = ancestor
WHERE greatest(a.batch, b.batch) = 2 OR ancestor NOT LIKE 'N:%'""", "closure", "concepts"))
def stream_closure_delta(v: Views) -> DataFrame:
    """All modules in three batches; nations have nothing below them until the last one's hierarchy."""
    folder, members, edges = new_path(v.spark, "codes"), new_path(v.spark, "members"), new_path(v.spark, "edges")
    state, now = new_path(v.spark, "stream-state"), {}
    seen = lambda batch: v.closure if batch == 2 else v.closure.filter("ancestor NOT LIKE 'N:%'")
    for batch, modules in enumerate((["nation", "part"], ["orders", "brand"], ["customer", "region", "supplier", "type", "root"])):  # a batch each: the stream goes on after the files it has seen
        now["closure"] = seen(batch)
        v.concepts.filter(F.col("module").isin(modules)).select("code").write.mode("append").parquet(folder)
        stream = v.spark.readStream.schema("code string").parquet(folder)
        St.stream_closure_delta(stream, lambda _: now["closure"], members, edges, state).awaitTermination()
    return v.spark.read.parquet(edges).select("source", "target", F.col("version").cast("int").alias("batch"))


@query("stream_feed_select", "SELECT CAST(o_custkey AS VARCHAR) AS canonical, o_orderpriority AS version, strftime(max(o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY ALL")
def stream_feed_select(v: Views) -> DataFrame:
    """The newest offer that was let through for each pair."""
    folder, sink = new_path(v.spark, "offers"), new_path(v.spark, "stream")
    v.raw("orders").select(F.col("o_custkey").cast("string").alias("canonical"), F.col("o_orderpriority").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).write.parquet(folder)
    offers = v.spark.readStream.schema("canonical string, version string, date string").parquet(folder)
    St.for_each_batch(St.stream_feed_select(offers), lambda b: b, sink, new_path(v.spark, "stream-state"), mode="update").awaitTermination()
    return v.spark.read.parquet(sink).groupBy("canonical", "version").agg(F.max("date").alias("date"))
