"""Mixing sources to target weights by a low-discrepancy source schedule (native).

The mix is a row of slots of one block each. Slot by slot, van der Corput points (whole numbers with
their bits in reverse, so exact at any length) are mapped through the cumulative target weights and
name the slot's source; the r-th slot of a source takes the r-th block of that source's shuffled word
stream. A stream is the source's documents in hash order, laid end to end, and repeats from its start
after the last document. Blocks hold equal numbers of words; only a source's last block may be
shorter, so that every source ends on its target to the word. What the schedule does not ask for is
not taken: any first part of it is a mix of the same weights, to a few blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ROWS_PER_BUCKET, buckets_for, cut, rows_each, running

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4_096
#: Up to so many sources, the grid of cells is broadcast (about 100 bytes a source, 10 MB); beyond, it is joined by shuffle.
MANY_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    #: source, source_size, buckets, source_no, weight, target, words (to take), blocks
    sources: DataFrame
    #: slot (place in the mix, ascending, below `span`), source_no, block
    schedule: DataFrame
    span: int
    #: row_id, source_no, block, slot, epoch, first_word, n_words: what of which document a slot holds
    segments: DataFrame
    #: row_id, doc_id, text_crc32, text_hash, source, size, source_size, target, taken, first_slot, slots (all that hold words of it; null, like first_slot, where none does)
    documents: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size and any others) with source_no, weight and target.

    Sources by code point with null last take the weights in turn. Targets share `share` of all sizes
    out by weight; what is above a source's cap is shared out again among the others, round by
    round, until none is above. A round is one aggregation; the driver sees its two sums.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_all", F.lit(0)).withColumn("_part", F.spark_partition_id())
    named = running(cut(ranged, "mix-names"), "_all", "_part", [F.col("source").asc_nulls_last()], F.lit(1), "source_no").drop("_all", "_part", "_total")
    named = cut(named.withColumn("weight", F.get(cycle, F.col("source_no") % len(weights))).withColumn("_cap", F.col("source_size") * F.lit(cap)), "mix-weights")
    level, closed = 0.0, -1
    total = (named.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.col("_cap") < F.col("weight") * F.lit(level)
        n, held, open_weight = named.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == closed:
            break
        closed = n
        level = (total - held) / open_weight if open_weight else level
    return named.select(*sizes.columns, "source_no", "weight", F.least("_cap", F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 256, seed: int = 11, part: float = 1.0
) -> Mix:
    """The mix of docs (doc_id, text, source; other columns are ignored), or the first `part` of it.

    A null text has no words. Documents without words are never taken. A null source is a source of
    its own, the last. Repeated rows and repeated or null ids are rows of their own (row_id). An
    empty table gives empty frames. Reruns over the same files agree: order within a source comes
    from hashes of id and text.
    """
    return _mix(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row_id")), weights, share, cap, block, seed, part)


def _mix(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, block: int, seed: int, part: float) -> Mix:
    spark = rows.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    base = cut(rows.select("row_id", "doc_id", "source", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("text_hash")), "mix-rows")
    rows_held = base.count()
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / rows_each(spark, rows_held)).alias("buckets"))
    sources = cut(
        targets(sizes, weights, share, cap)
        .withColumn("words", F.least(F.round("target"), F.col("source_size") * F.lit(cap)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("words") / block)),
        "mix-sources",
    )
    schedule, span = source_schedule(sources, buckets_for(spark, rows_held), part)
    schedule = cut(schedule, "mix-schedule")
    # a source gives as many blocks as the schedule has slots for it
    given = sources.join(schedule.groupBy("source_no").agg(F.count(F.lit(1)).alias("_slots")), "source_no", "left")
    given = given.withColumn("_words", F.least("words", F.coalesce("_slots", F.lit(0)) * block)).drop("words", "blocks", "weight", "_slots")

    # streams: where each document starts in its source
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32")
    placed = running(
        base.join(F.broadcast(given) if sources.count() <= MANY_SOURCES else given, base.source.eqNullSafe(given.source)).select(base["*"], "source_no", "source_size", "target", "_words", "buckets")
        .withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.col("buckets"))),
        "source_no", "_bucket", ["_key", "doc_id", "row_id"], F.col("size"), "_start",
    )
    epochs = F.explode(F.when(F.col("_words") > F.col("source_size"), F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))).otherwise(F.array(F.lit(0))))
    pieces = (
        placed.withColumn("epoch", epochs)
        .withColumn("_from", F.col("epoch") * F.col("source_size") + F.col("_start"))
        .withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_words")))
        .filter("_to > _from")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
        .withColumn("_low", F.greatest("_from", F.col("block") * block))
        .select(
            "row_id", "source_no", "block", "epoch",
            (F.col("_low") - F.col("_from")).alias("first_word"),
            (F.least("_to", (F.col("block") + 1) * block) - F.col("_low")).alias("n_words"),
        )
    )
    segments = pieces.join(schedule, ["source_no", "block"]).select("row_id", "source_no", "block", "slot", "epoch", "first_word", "n_words")
    taken = segments.groupBy("row_id").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.sort_array(F.collect_set("slot")).alias("slots"))
    out = (
        placed.select("row_id", "doc_id", "text_crc32", "text_hash", "source", "size", "source_size", "target")
        .join(taken, "row_id", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    )
    return Mix(sources, schedule, span, segments, out)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, in the order of its slots: once for each epoch that takes over half of their words.

    Words come near the targets to one document a source. A row's place is the first slot that takes
    of it in that epoch; the result is sorted by it inside its partitions, and partitions follow each
    other. Documents without words (or text) stay once, at places of their hash: they take no part in
    the mix and no room in it. Repeated rows and null ids are rows of their own; all columns, whatever
    their names, are passed on. An empty table gives an empty result.

    Rows meet their places by id and text hash; only where these repeat are rows written with a number
    first, to be told apart by it.
    """
    mix = mix_sources(docs, weights, share, cap)
    key, rows = ["_key", "text_hash"], docs.select(_whole(docs), _key("doc_id"), F.xxhash64("text").alias("text_hash"))
    n, several = mix.documents.groupBy(_key("doc_id"), "text_hash").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if several > 1:
        key, rows = ["row_id"], cut(docs.select(_whole(docs), F.monotonically_increasing_id().alias("row_id")), "mix-whole")
        mix = _mix(rows.select("row.doc_id", "row.source", "row.text", "row_id"), weights, share, cap, 256, 11, 1.0)
    known = mix.documents.select("row_id", _key("doc_id"), "text_hash", "size")
    met = mix.segments.groupBy("row_id", "epoch").agg(F.sum("n_words").alias("_words"), F.min("slot").alias("_slot"))
    wordy = met.join(known, "row_id").filter("_words * 2 > size").select(*key, "_slot")
    bare = known.filter("size = 0").select(*key, F.pmod(F.xxhash64("row_id"), F.lit(mix.span)).alias("_slot"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_BUCKET))
    placed = rows.join(wordy.unionByName(bare).hint("merge"), key)
    return placed.repartitionById(parts, F.floor(F.col("_slot") / mix.span * parts).cast("int")).sortWithinPartitions("_slot", *key).select("row.*")


def _whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _key(c: str) -> Column:
    """An id of any type, or none, as text."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("_key")


def source_schedule(sources: DataFrame, buckets: int, part: float = 1.0) -> tuple[DataFrame, int]:
    """(slot, source_no, block) and the number that all slots are below; only the first `part` of the slots.

    Slot j, with its bits in reverse, is a point among as many whole numbers as there are blocks in
    all (points beyond are left out), and belongs to the source whose share of them holds it: the
    cumulative weights are looked up over a grid of cells. A source's slots are ranked in order and
    the rank is the block. Over all slots every block has one.
    """
    spark = sources.sparkSession
    total, names = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(1, int(total - 1).bit_length()) if total else 1
    span = 1 << bits
    ranges = running(sources.filter("blocks > 0").select("source_no", "blocks", F.lit(0).alias("_all"), F.floor(F.col("source_no") / 65_536).alias("_part")), "_all", "_part", ["source_no"], F.col("blocks"), "_low")
    ranges = ranges.select("source_no", "_low", (F.col("_low") + F.col("blocks")).alias("_high"))
    width = -(-total // CELLS) or 1
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_high") - 1) / width))))
    points = spark.range(int(span * part)).select(F.col("id").alias("slot"), F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long").alias("_v")).filter(F.col("_v") < total)
    points = points.withColumn("_cell", F.floor(F.col("_v") / width)).withColumn("_bucket", F.floor(F.col("slot") * buckets / span))
    cells = F.broadcast(cells) if names <= MANY_SOURCES else cells  # at most CELLS rows and two more a source
    named = points.join(cells, "_cell").filter("_v >= _low AND _v < _high").select("slot", "source_no", "_bucket")
    return running(named, "source_no", "_bucket", ["slot"], F.lit(1), "block").select("slot", "source_no", "block"), span
