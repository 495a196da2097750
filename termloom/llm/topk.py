"""Exact top-k by inner product: distributed histogram selection.

Every query is scored against every candidate, in blocks, once a pass, and no score is ever stored.
Each pass narrows, for every query, the range of scores that holds its kth highest: a block reports
how many of its k highest scores fall into each of the range's bins, which is all that can matter.
Once the range is one score wide, a last pass keeps what is above it and, of ties, the least ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import cut

#: Bins of a range; a block reports k of them at most, so that there can be many.
BINS = 4_096
#: Vectors of one block, of candidates and of queries.
BLOCK, QUERIES = 4_096, 512
#: Bytes (as doubles) of the query vectors that a cell of the grid holds, and of the candidates that pass by them.
CELL_QUERIES, CELL_CANDIDATES = 64_000_000, 256_000_000
#: Scores are held in a long; what is beyond its ends counts as them.
_END = 2**63 - 1
#: Whole numbers up to here are exact as doubles, and so are their sums.
_EXACT = 2**53


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale x component), whole numbers; without null vectors and those with a null or non-finite component.

    Components so large that `scale` times them is no double count as the largest one.
    """
    x, most = F.col("embedding"), float(np.finfo(np.float64).max)
    fit = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    # from 2^52 on, doubles are whole: floor would only overflow
    whole = lambda c: F.when(F.abs(c) < 2.0**46, F.floor(c * scale).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), c * scale)))
    return df.filter(fit).select("vec_id", F.transform(x, lambda c: whole(c.cast("double"))).alias("v"))


def _blocks(rows: DataFrame, width: int, parts: int, name: str) -> DataFrame:
    """(name, ids, data): vectors packed into blocks, dealt by hash; shorter vectors end in zeros. Data is of 32-bit numbers where all fit, else of doubles."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        made = []
        for frame in frames:
            for at, group in frame.groupby("_at"):
                held.setdefault(at, []).append(group)
        for at, groups in held.items():
            group = pd.concat(groups).sort_values("vec_id", kind="stable")
            v = np.zeros((len(group), width))
            for i, x in enumerate(group["v"]):
                v[i, : len(x)] = x
            data = v.astype(np.int32) if np.abs(v).max(initial=0) < 2**31 else v
            made.append((at, group["vec_id"].to_numpy(np.int64).tobytes(), data.tobytes()))
        yield pd.DataFrame(made, columns=[name, "ids", "data"])

    dealt = rows.withColumn("_at", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))
    return dealt.repartition(parts, "_at").mapInPandas(pack, f"{name} int, ids binary, data binary")


def grid(q_parts: int, c_parts: int, width: int, tasks: int) -> tuple[int, int]:
    """Rows (of query blocks) and columns (of candidate blocks) of the cells in which blocks meet.

    Candidates move once a row and queries once a column. Cells keep to their bytes (or hold one block), and there are at
    least `tasks` of them, or one a pair of blocks; of rows and columns, those are added that move fewer bytes.
    """
    rows = -(-q_parts // max(1, CELL_QUERIES // (8 * width * QUERIES)))
    columns = -(-c_parts // max(1, CELL_CANDIDATES // (8 * width * BLOCK)))
    while rows * columns < min(tasks, q_parts * c_parts):
        if columns < c_parts and (rows == q_parts or q_parts * QUERIES * columns <= c_parts * BLOCK * rows):
            columns = min(c_parts, 2 * columns)
        else:
            rows = min(q_parts, 2 * rows)
    return rows, columns


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * width else np.float64).reshape(rows, width).astype(np.float64)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as longs; exact, but cut off at the ends of a long."""
    q_most, c_most, width = np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0), max(1, q.shape[1])
    most = int(q_most.max(initial=0)) * int(c_most.max(initial=0)) * width
    if most < _EXACT:
        return (q @ c.T).astype(np.int64)
    if most < _END:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    # rows with huge components go one by one, in whole numbers of any size
    limit = (_END / width) ** 0.5 / 2
    wide_q, wide_c = q_most >= limit, c_most >= limit
    out = np.zeros((len(q), len(c)), np.int64)
    if not (wide_q.all() or wide_c.all()):
        out[np.ix_(~wide_q, ~wide_c)] = exact_products(q[~wide_q], c[~wide_c])
    whole_q, whole_c = ([[int(x) for x in row] for row in m] for m in (q, c))
    for i in range(len(q)):
        for j in range(len(c)) if wide_q[i] else np.flatnonzero(wide_c):
            out[i, j] = max(-_END, min(_END, sum(x * y for x, y in zip(whole_q[i], whole_c[j]))))
    return out


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row (all, if fewer), in no order."""
    return scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller vec_id.

    queries and candidates are (vec_id, v) with v of whole numbers (integer_vectors makes them);
    other columns are ignored. Of vectors of unequal widths, the shorter counts as ending in zeros; an
    empty one scores 0. A query is not its own candidate: rows of its vec_id are left out. With fewer
    than k candidates, all come. Repeated candidate rows come once each; repeated query ids must hold
    equal vectors. Rows with a null vec_id take no part. Empty tables give an empty result. Scores are
    exact; one beyond the range of a long counts as the end of it.
    """
    spark = queries.sparkSession
    queries, candidates = (x.filter("vec_id IS NOT NULL").select("vec_id", F.col("v").cast("array<double>").alias("v")) for x in (queries, candidates))
    measures = F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    (n, c_width, c_most), (m, q_width, q_most) = (x.agg(*measures).first() for x in (candidates, queries))
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, c_width, q_width)
    bound = min(_END, width * int(c_most or 0) * int(q_most or 0) + 1)  # no score is beyond
    c_parts, q_parts = -(-n // BLOCK), -(-m // QUERIES)
    rows, columns = grid(q_parts, c_parts, width, 3 * spark.sparkContext.defaultParallelism)
    c_blocks = cut(_blocks(candidates, width, c_parts, "cb"), "top-candidates")
    q_blocks = cut(_blocks(queries.dropDuplicates(["vec_id"]), width, q_parts, "qb"), "top-queries")

    def scored(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.Series]]:
        """Ids, scores, and which scores count: at least the query's range, and not its own row."""
        for row in frame.itertuples(index=False):
            q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
            scores = exact_products(_matrix(row.q_data, len(q_ids), width), _matrix(row.data, len(c_ids), width))
            counts = (scores >= np.frombuffer(row.low, np.int64)[:, None]) & (q_ids[:, None] != c_ids[None, :])
            yield q_ids, c_ids, scores, counts, row

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, _, scores, counted, row in scored(frame):
                low, step = (np.frombuffer(x, np.int64) for x in (row.low, row.step))
                top = _highest(np.where(counted, scores, -_END - 1), k)
                at, column = np.nonzero(top >= low[:, None])
                above = top[at, column].view(np.uint64) - low[at].view(np.uint64)  # no overflow: it is not negative
                cell, sums = np.unique(at * (BINS + 1) + np.minimum(above // step[at].view(np.uint64), BINS).astype(np.int64), return_counts=True)  # bin BINS: all above the range
                yield pd.DataFrame({"qb": row.qb, "query_id": q_ids[cell // (BINS + 1)], "bin": cell % (BINS + 1), "n": sums})

    def met(ranges: DataFrame) -> DataFrame:
        """Each query block beside each candidate block, with the ranges of the block's queries in the order of its ids."""
        lists = ranges.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "step"))).alias("r"))  # a block's queries
        packed = q_blocks.join(lists, "qb").select(
            "qb", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("r.low").alias("lows"), F.col("r.step").alias("steps")
        )

        def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["low"] = [np.asarray(x, np.int64).tobytes() for x in f["lows"]]
                f["step"] = [np.asarray(x, np.int64).tobytes() for x in f["steps"]]
                yield f[["qb", "q_ids", "q_data", "low", "step"]]

        packed = packed.mapInPandas(flat, "qb int, q_ids binary, q_data binary, low binary, step binary")
        # every block of queries meets every block of candidates: a stated query set, in blocks. A cell's candidates stream past its queries
        asked = packed.withColumn("row", F.pmod("qb", F.lit(rows))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        offered = c_blocks.select("ids", "data", F.pmod("cb", F.lit(columns)).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
        offered, asked = (x.repartition(rows * columns, "row", "column") for x in (offered, asked))
        return offered.hint("merge").join(asked, ["row", "column"])

    step = -(-2 * bound // BINS)
    number = lambda c: F.col(c).cast("decimal(38,0)")

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame({"qb": row.qb, "query_id": np.frombuffer(row.ids, np.int64)})

    ranges = q_blocks.mapInPandas(ids, "qb int, query_id long").withColumn("low", F.lit(-bound).cast("long")).withColumn("step", F.lit(step).cast("long"))
    down = Window.partitionBy("qb", "query_id").orderBy(F.col("bin").desc())
    while True:
        seen = met(ranges).mapInPandas(counts, "qb int, query_id long, bin int, n long").groupBy("qb", "query_id", "bin").agg(F.sum("n").alias("n"))
        reached = seen.withColumn("_sum", F.sum("n").over(down)).filter(F.col("_sum") >= k).groupBy("qb", "query_id").agg(F.max("bin").alias("bin"))
        # with fewer than k candidates in all, the range stays at its lowest bin
        ranges = ranges.join(reached, ["qb", "query_id"], "left").select(
            "qb", "query_id", (number("low") + F.coalesce("bin", F.lit(0)) * number("step")).cast("long").alias("low"), F.lit(max(1, -(-step // BINS))).cast("long").alias("step")
        )
        ranges = cut(ranges, "top-ranges")
        if step == 1:
            break
        step = max(1, -(-step // BINS))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, c_ids, scores, counted, _ in scored(frame):
                i, j = np.nonzero(counted)
                order = np.lexsort((c_ids[j], -scores[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]  # of ties at the kth score, a block's k least ids are enough
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[j], "score": scores[i, j]})

    found = met(ranges).mapInPandas(keep, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
