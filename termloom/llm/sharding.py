"""Sharding by a hypergeometric communication matrix (native).

A uniform shuffle into shards of exact sizes in two passes. Rows lie in P map parts. For each part
the numbers of rows that go to each shard are drawn from the multivariate hypergeometric law, given
what earlier parts have taken, so that shard sizes are exact and every assignment of rows to shards
is equally likely. Each part permutes its rows and deals them out by its counts; each shard then
permutes what it has received.

The matrix (at most MAX_PARTS x shards integers, whatever the input) is the only thing the driver
sees. Rows move twice, as a few numbers each, never with their text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import buckets_for, cut, free_names, running, small_frame

MAX_PARTS = 16_384


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` out of good + bad; numpy's own up to its bound, inversion from the mode beyond."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lf = math.lgamma
    log_p = lambda x: -lf(x + 1) - lf(good - x + 1) - lf(draws - x + 1) - lf(bad - draws + x + 1)
    total = lf(good + bad + 1) - lf(draws + 1) - lf(good + bad - draws + 1)
    p_mode = math.exp(log_p(mode) + lf(good + 1) + lf(bad + 1) - total)
    u, left, right, p_left, p_right = rng.random() - p_mode, mode, mode, p_mode, p_mode
    while u > 0 and (left > low or right < high) and max(p_left, p_right) > 1e-18:
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(part_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row p: how many rows of part p go to each shard. Columns sum to shard sizes that differ by one at most."""
    total = sum(part_rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for rows in part_rows:
        row, left, space = [], rows, sum(room)
        for s in range(shards):
            n = hypergeometric(rng, room[s], space - room[s], left) if left else 0
            row.append(n)
            left -= n
            space -= room[s]
            room[s] -= n
        out.append(row)
    return out


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """df with `shard` (0..shards-1, counts at most one apart) and `slot` (gapless from 0 in each shard).

    df should hold only keys and small columns: it is written once to the shared folder so that
    later passes, and tasks that are run again after an executor is lost, see the same row numbers.
    Nulls, repeated rows and ties need no care: rows are told apart by their row number. An empty
    table gives an empty result. Columns named shard or slot in df are replaced; other columns keep
    their names, whatever they are: working columns take names that are free.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    row, part, end, rank, key, bucket = free_names(df, "_s_id", "_s_part", "_s_ends", "_s_rank", "_s_key", "_s_bucket")
    base = cut(df.select(*[F.col(f"`{c}`") for c in keep]).withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    rows = base.count()
    parts = min(MAX_PARTS, buckets_for(spark, rows))
    dealt = base.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(parts)).cast("int"))
    held = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # at most MAX_PARTS rows
    matrix = communication_matrix([held.get(p, 0) for p in range(parts)], shards, seed)
    ends = [{part: p, end: np.cumsum(counts).tolist()} for p, counts in enumerate(matrix)]
    plan = F.broadcast(small_frame(spark, ends, f"{part} int, {end} array<bigint>"))  # MAX_PARTS x shards numbers at most
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), row), row)
    sent = (
        dealt.withColumn(rank, F.row_number().over(local))
        .join(plan, part)
        .withColumn("shard", F.size(F.filter(end, lambda e: e < F.col(rank))))
        .withColumn(key, F.xxhash64(F.lit(seed + 2), row))
        .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 3), row), F.lit(parts)))
    )
    placed = running(sent, "shard", bucket, [key, row], F.lit(1), "slot")
    return placed.select(*[F.col(f"`{c}`") for c in keep], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text); the law is `rows`.

    A null text, like an empty one, has size 8 and crc 0. Equal texts, repeated rows and null ids are
    rows of their own and are dealt one by one; other columns are ignored. An empty table gives an
    empty result.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    small = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(small, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
