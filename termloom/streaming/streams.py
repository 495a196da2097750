"""Stream forms of the batch operators: each micro-batch runs the batch operator on the static side as it then is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import codes as K
from termloom.operators import hierarchy as H
from termloom.tables import cut, forget


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs work on each micro-batch and writes its result under sink/batch=<id>: a replayed batch overwrites its own folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_validate(events: DataFrame, tables: Callable[[SparkSession], tuple[DataFrame, DataFrame]], sink: str, checkpoint: str) -> StreamingQuery:
    """validate_codes on coded events as they arrive; tables() gives (concepts, systems) anew for every batch."""
    return for_each_batch(events, lambda b: K.validate_codes(b, *tables(b.sparkSession)).withColumn("issues", F.transform("issues", lambda x: x["reason"])), sink, checkpoint)


def stream_translate(events: DataFrame, tables: Callable[[SparkSession], tuple[DataFrame, DataFrame]], name: str, sink: str, checkpoint: str) -> StreamingQuery:
    """translate_unmapped on events as they arrive; tables() gives (elements, unmapped) anew for every batch."""
    return for_each_batch(events, lambda b: K.translate_unmapped(b, *tables(b.sparkSession), name), sink, checkpoint)


def stream_rollup(events: DataFrame, closure: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per window and ancestor (or the code itself) of events (ts, code), for append mode: a window's counts come once, when it is over.

    Events are first counted by window and code; the counts meet the ancestors and are summed. A
    window is over once the watermark, `delay` before the latest event of the batches before, has
    passed its end; rows that come later than that are dropped, as the engine does.
    """
    up = closure.groupBy(F.col("descendant").alias("code")).agg(F.sort_array(F.collect_set("ancestor")).alias("up"))
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "code").agg(F.count(F.lit(1)).alias("n"))
    spread = counted.join(up, "code", "left").select("w", "n", F.explode(F.concat(F.array("code"), F.coalesce("up", F.array().cast("array<string>")))).alias("code"))
    return spread.groupBy("w", "code").agg(F.sum("n").alias("n")).select(F.col("w.start").alias("start"), "code", "n")


def stream_closure_delta(new_codes: DataFrame, tables: Callable[[SparkSession], DataFrame], members_path: str, edges_path: str, checkpoint: str) -> StreamingQuery:
    """Edges that each batch of new codes adds to a kept closure table; the version is the batch id, so a replay writes the same rows again.

    tables() gives the closure anew for every batch, so that the stream follows a hierarchy that changes.
    Only the closure's pairs that have one of the batch's codes give edges.
    """
    spark = new_codes.sparkSession
    kind = "code string"
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{members_path}/version=-1")  # so that the first batch, too, finds a table

    def run(batch: DataFrame, batch_id: int) -> None:
        closure = tables(batch.sparkSession)
        held = batch.sparkSession.read.schema(f"{kind}, version long").parquet(members_path).filter(F.col("version") < batch_id).select("code")
        fresh = cut(batch.select("code").distinct().join(held, "code", "left_anti"), "stream-codes")
        delta = H.closure_delta(held, fresh, closure)
        delta.write.mode("overwrite").parquet(f"{edges_path}/version={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{members_path}/version={batch_id}")

    return new_codes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_late(events: DataFrame, sink: str, marks: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes") -> StreamingQuery:
    """Counts per window and code of the events (ts, code) that come too late for stream_rollup, one row a batch, window and code.

    An event is late if its window had ended by the watermark of the batches before: the latest event
    among them less the delay. marks keeps that latest event for each batch, and only as long as a replay of the batch
    after may ask for it, so that what is kept does not grow with the stream.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = lambda i: f"{marks}/batch={i}"
        before = spark.read.parquet(folder(batch_id - 1)).first()["latest"] if batch_id else None
        batch = batch.select("ts", "code").persist()
        latest = batch.agg(F.max("ts").alias("latest")).select(F.greatest("latest", F.lit(before).cast("timestamp")).alias("latest"))
        latest.write.mode("overwrite").parquet(folder(batch_id))
        windowed = batch.select(F.window("ts", window).alias("w"), "code")
        late = windowed.filter(F.col("w.end") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")).groupBy("w", "code").agg(F.count(F.lit(1)).alias("n"))
        late.select(F.col("w.start").alias("start"), "code", "n").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()
        forget(spark, folder(batch_id - 2))

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_feed_select(offers: DataFrame, keep: str = "30 days") -> DataFrame:
    """The newest date of each pair of offers (canonical, version, date as text), for update mode: one row a pair, span of `keep` and batch in which the pair had an offer.

    What is kept ends: a pair's offers are summed up by spans of time, and a span is given up once the latest offer of
    the batches before is further ahead of its end than it is long. Offers that are older than that can be no
    pair's newest but that of one that has long been silent; they are dropped.
    """
    timed = offers.withColumn("ts", F.to_timestamp("date")).withWatermark("ts", keep)
    return timed.groupBy("canonical", "version", F.window("ts", keep).alias("w")).agg(F.max("date").alias("date")).drop("w")
