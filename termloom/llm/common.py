"""Shared helpers of the corpus operators: ASCII case, two-level running sums, small frames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.tables import cut, scratch, table

__all__ = ["BROADCAST_BYTES", "ascii_lower", "buckets_for", "cut", "free_names", "rows_each", "running", "scratch", "small_frame", "table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What an operator sends to every executor at once holds so many bytes at most; beyond, it takes a join.
BROADCAST_BYTES = 64_000_000
#: Largest number of rows that one (group, bucket) of a two-level numbering should hold.
ROWS_PER_BUCKET = 65_536


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def buckets_for(spark: SparkSession, rows: int) -> int:
    """How many buckets a hot group is spread over: grows with the rows, never below four a shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))


def rows_each(spark: SparkSession, rows: int) -> int:
    """Rows of one bucket where a group takes buckets by its own size: a hot group has many, a rare one has one."""
    return max(1, min(ROWS_PER_BUCKET, -(-rows // buckets_for(spark, 0))))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns: those given, with underscores before them until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, key: str, bucket: str, order: list[str], size: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows of the same `key` that come before, in order of (bucket, order).

    Two levels, so that no task holds a whole group: running sums inside each (key, bucket), and
    running sums over the bucket totals of each key. `key` and `bucket` hold no nulls.
    """
    own, total, before, local = free_names(df.select(*[c for c in df.columns if c != out]), "_size", "_total", "_before", "_local")
    inner = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = df.withColumn(own, size.cast("long"))
    totals = sized.groupBy(key, bucket).agg(F.sum(own).alias(total))
    earlier = totals.select(key, bucket, (F.sum(total).over(outer) - F.col(total)).alias(before))
    placed = sized.withColumn(local, F.sum(own).over(inner) - F.col(own))
    return placed.join(earlier, [key, bucket]).withColumn(out, F.col(before) + F.col(local)).drop(own, local, before)


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A driver-side table of bounded size as a DataFrame that needs no Python on the executors."""
    return spark.sql("SELECT inline(from_json(:rows, :kind))", args={"rows": json.dumps(rows), "kind": f"array<struct<{schema}>>"})
