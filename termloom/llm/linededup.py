"""Line dedup: exact reference counts of line keys, with sharded cuckoo filters before them.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; it is known
by its 128-bit xxhash. The index is a table of exact reference counts (in how many documents a key
is found). Documents are inserted by adding their counts and deleted by taking them away, so the
index after a deletion is the index without that document. The keys that are common enough to be
dropped are also held in cuckoo filters, one a shard, which follow the counts by insertions and
deletions. Cleaning asks the filters about every line and the exact counts about the few that pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.arrow import map_slices, slices, utf8
from termloom.llm.common import BROADCAST_BYTES, cut, free_names
from termloom.llm.cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
#: Keys of one filter, about.
SHARD_KEYS = 32_768
#: Tasks that the lines of one shard are dealt over, beyond the limits of what is sent to all executors.
SALTS = 16
#: Up to so many bytes of exact common keys (16 each) go to every executor; more are met by a join.
EXACT_BYTES = 32_000_000
_KEY = np.dtype([("h1", "<u8"), ("h2", "<u8")])


def line_keys(lines: list[bytes]) -> np.ndarray:
    """The 128-bit keys of lines; those of an empty key are 0, 0."""
    stripped = [x.strip(SPACE).lower() for x in lines]
    raw = b"".join([xxhash.xxh3_128_digest(x) if x else bytes(16) for x in stripped])
    return np.frombuffer(raw, _KEY)


def key_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many rows of docs each non-empty key is found; summed inside each slice first."""

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        found = [np.unique(line_keys(x.split(b"\n"))) for x in utf8(batch.column(0))]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        keep = (keys["h1"] != 0) | (keys["h2"] != 0)
        return {"h1": pa.array(keys["h1"][keep].view(np.int64)), "h2": pa.array(keys["h2"][keep].view(np.int64)), "n": pa.array(n[keep])}

    parts = map_slices(docs.select(F.col("text").cast("binary")), make, "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_filters(common: DataFrame, shards: int) -> DataFrame:
    """(shard, data): the cuckoo filter of each shard's keys (h1, h2)."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "data": [CuckooFilter.of(np.sort(keys["h1"].to_numpy().view(np.uint64))).dump()]})

    return common.select("h1", "h2", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, data binary")


def _shard(shards: int) -> Column:
    return F.pmod("h2", F.lit(shards)).cast("int").alias("shard")


def update_filters(filters: DataFrame, gone: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Filters after keys `gone` (all of them held) were deleted and keys `new` (none of them held) inserted.

    A full filter cannot be grown from its marks alone, so its shard comes back with data null, to be
    built again from the exact counts.
    """
    change = gone.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))).select("h1", "sign", _shard(shards))

    def apply(key: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(keys):
            return held[["shard", "data"]]
        mine = CuckooFilter.load(held["data"].iloc[0], change=True) if len(held) else CuckooFilter(max(2, 1 << int(np.ceil(np.log2(max(2, len(keys)))))))
        h1 = keys["h1"].to_numpy().view(np.uint64)
        for k in h1[(keys["sign"] < 0).to_numpy()]:
            mine.delete(k)
        fits = all(mine.insert(k) for k in h1[(keys["sign"] > 0).to_numpy()])
        return pd.DataFrame({"shard": [key[0]], "data": [mine.dump() if fits else None]})

    return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, "shard int, data binary")


class LineIndex:
    """Exact reference counts of line keys (h1, h2, n), and cuckoo filters (shard, data) of the keys with n >= min_docs.

    Both move together: inserting or deleting documents changes the counts, and the keys that thereby
    become common, or cease to be, are inserted into the filters or deleted from them. A filter thus
    only ever loses a key that it holds. Deleting what was inserted gives the index from before.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, shards: int) -> None:
        self.counts, self.filters, self.min_docs, self.shards = counts, filters, min_docs, shards
        self._common: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 10, shard_keys: int = SHARD_KEYS) -> LineIndex:
        counts = key_counts(docs)
        common = cut(counts.filter(F.col("n") >= min_docs).select("h1", "h2"), "line-keys")
        shards = max(1, -(-common.count() // shard_keys))
        made = cls(counts, cut(build_filters(common, shards), "line-filters"), min_docs, shards)
        made._common = common
        return made

    @property
    def common(self) -> DataFrame:
        """The exact keys (h1, h2) that the filters hold."""
        if self._common is None:
            self._common = cut(self.counts.filter(F.col("n") >= self.min_docs).select("h1", "h2"), "line-keys")
        return self._common

    def _moved(self, docs: DataFrame, sign: int) -> LineIndex:
        change = key_counts(docs).select("h1", "h2", (F.col("n") * sign).alias("_change"))
        before = F.coalesce("n", F.lit(0))
        both = cut(self.counts.join(change, ["h1", "h2"], "full_outer").select("h1", "h2", before.alias("_was"), (before + F.coalesce("_change", F.lit(0))).alias("n")), "line-counts")
        if sign < 0 and not both.filter("n < 0").isEmpty():
            raise ValueError("documents to be deleted hold lines that were never inserted")
        was, now = F.col("_was") >= self.min_docs, F.col("n") >= self.min_docs
        filters = cut(update_filters(self.filters, both.filter(was & ~now).select("h1", "h2"), both.filter(~was & now).select("h1", "h2"), self.shards), "line-filters")
        full = filters.filter("data IS NULL").select("shard")
        if not full.isEmpty():
            keys = both.filter(now).select("h1", "h2", _shard(self.shards)).join(full, "shard", "left_semi")
            filters = cut(filters.filter("data IS NOT NULL").unionByName(build_filters(keys, self.shards)), "line-filters")
        return LineIndex(both.filter("n > 0").select("h1", "h2", "n"), filters, self.min_docs, self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Docs must have been inserted before (a line that never was is an error); then this undoes it."""
        return self._moved(docs, -1)


def _passes(filters: dict[int, CuckooFilter], shards: int, keys: np.ndarray) -> np.ndarray:
    """Which keys some shard's filter may hold."""
    out, shard = np.zeros(len(keys), bool), keys["h2"].view(np.int64) % shards
    for s in np.unique(shard).tolist():
        if s in filters:
            at = np.flatnonzero(shard == s)
            out[at] = filters[s].contains(keys["h1"][at])
    return out


def drop_common_lines(
    docs: DataFrame, index: LineIndex | None = None, min_docs: int = 10, names: tuple[str, str] = ("n_lines", "n_dropped"), exact_bytes: int = EXACT_BYTES, filter_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """docs with every line gone whose key is found in min_docs documents or more; adds n_lines and n_dropped.

    The index defaults to that of docs themselves (a given one brings its own min_docs). The text is
    split at \\n; a null or empty text is one empty line, which stays (the result is then an empty
    text). Lines of an empty key always stay. Other columns are passed on, whatever their names; those
    that are named as the two new ones (`names`) are replaced. Repeated rows count as documents of
    their own; doc_id may be null. An empty table gives an empty result.

    Every line first meets the filters. Where exact keys (16 bytes each) and filters (about 3) are
    within their limits, both go to all executors, and the text never moves. Beyond exact_bytes or
    filter_bytes, line keys meet the filters by shard and salt, those that pass meet the exact keys in a
    join (hot keys are split by AQE), and the numbers of the lines to drop meet the text by hashes of id
    and text: neither filters nor keys pass the driver then.
    """
    docs = docs.drop(*names)
    index = index or LineIndex.of(docs, min_docs)
    held = index.filters.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    if index.common.count() * 16 > exact_bytes or held > filter_bytes:
        return _drop_by_join(docs, index, names)
    keys = index.common.toArrow()  # exact_bytes at most
    exact = np.empty(keys.num_rows, _KEY)
    exact["h1"], exact["h2"] = (keys.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    shards, kept = index.shards, docs.sparkSession.sparkContext.broadcast((_collected(index.filters), np.sort(exact)))
    return _drop_at(docs, names, None, lambda batch, parts: _common_at(kept.value, shards, parts))


def _collected(filters: DataFrame) -> dict[int, bytes]:
    table = filters.toArrow()
    return dict(zip(table.column("shard").to_pylist(), table.column("data").to_pylist()))


def _common_at(kept: tuple[dict[int, bytes], np.ndarray], shards: int, parts: list[list[bytes]]) -> list[set[int]]:
    """Line numbers to drop of each document of a slice: filters first, exact keys for what passes."""
    filters, exact = {s: CuckooFilter.load(x) for s, x in kept[0].items()}, kept[1]
    keys = line_keys([x for lines in parts for x in lines])
    hit = np.flatnonzero(_passes(filters, shards, keys) & ((keys["h1"] != 0) | (keys["h2"] != 0)))
    if len(hit) and len(exact):
        at = np.minimum(np.searchsorted(exact, keys[hit]), len(exact) - 1)
        hit = hit[exact[at] == keys[hit]]
    else:
        hit = hit[:0]
    ends = np.cumsum([len(x) for x in parts])
    owner = np.searchsorted(ends, hit, side="right")
    out: list[set[int]] = [set() for _ in parts]
    for d, line in zip(owner.tolist(), hit.tolist()):
        out[d].add(line - int(ends[d]) + len(parts[d]))
    return out


def _drop_at(docs: DataFrame, names: tuple[str, str], gone: str | None, lines_to_drop) -> DataFrame:  # noqa: ANN001
    """docs without the lines that lines_to_drop(batch, lines of each text) names, nor its column `gone`; adds the columns `names`."""
    fields = [T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema if f.name != gone]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in slices(batches):
            parts = [x.split(b"\n") for x in utf8(batch.column(batch.schema.get_field_index("text")))]
            drop = lines_to_drop(batch, parts)
            texts = [b"\n".join([x for i, x in enumerate(lines) if i not in g] if g else lines) for lines, g in zip(parts, drop)]
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), names[0]: pa.array([len(x) for x in parts], pa.int64()), names[1]: pa.array([len(g) for g in drop], pa.int64())}
            columns = [made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name)) for f in target]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return docs.mapInArrow(run, schema)


def _passing(keyed: DataFrame, filters: DataFrame, shards: int, by: list[str]) -> DataFrame:
    """Those rows of keyed (with h1, h2) that the filters may hold.

    Lines and filters meet by (shard, salt): each task streams a filter and then its lines, so that it holds
    one filter at a time and none passes the driver. A line takes its salt from the columns `by`, so that one that all documents share
    is dealt over SALTS tasks; each filter goes to all of them. A common key has three bytes or so in a filter and at least
    min_docs lines of forty, so the copies stay a small part of what moves.
    """
    shard, salt, data = free_names(keyed, "shard", "salt", "data")
    lines = keyed.withColumns({shard: _shard(shards), salt: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"), data: F.lit(None).cast("binary")})
    copies = filters.select(F.col("shard").alias(shard), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("data").alias(data))
    both = lines.unionByName(copies, allowMissingColumns=True).repartition(shard, salt).sortWithinPartitions(shard, salt, F.col(data).isNull())
    schema = keyed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None  # the filter that was seen last, and whose it is
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            group = np.asarray(column[shard], np.int64) * SALTS + np.asarray(column[salt], np.int64)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            keys = column["h1"].fill_null(0).to_numpy().view(np.uint64)
            keep = np.zeros(batch.num_rows, bool)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if column[data][start].is_valid:
                    held, of = CuckooFilter.load(column[data][start].as_py()), int(group[start])
                    start += 1
                if of == int(group[end - 1]) and start < end:  # a shard without common keys has no filter
                    keep[start:end] = held.contains(keys[start:end])
            yield batch.filter(pa.array(keep)).select([f.name for f in schema])

    return both.mapInArrow(run, schema)


def _drop_by_join(docs: DataFrame, index: LineIndex, names: tuple[str, str]) -> DataFrame:
    """The way for any number of common keys: lines meet their shard's filter in a stream, and what passes meets the exact keys in a join."""
    by_id, by_text, gone = free_names(docs, "_id", "_hash", "_gone")
    named = docs.withColumn(by_id, F.xxhash64("doc_id")).withColumn(by_text, F.xxhash64("text"))

    def lines(batch: pa.RecordBatch) -> dict[str, object]:
        parts = [line_keys(x.split(b"\n")) for x in utf8(batch.column(2))]
        sizes = [len(x) for x in parts]
        keys = np.concatenate(parts)
        keep = (keys["h1"] != 0) | (keys["h2"] != 0)
        made = {
            by_id: np.repeat(np.array(batch.column(0)), sizes), by_text: np.repeat(np.array(batch.column(1)), sizes),
            "line": np.concatenate([np.arange(n) for n in sizes]), "h1": keys["h1"].view(np.int64), "h2": keys["h2"].view(np.int64),
        }
        return {k: pa.array(v[keep]) for k, v in made.items()}

    spread = map_slices(named.select(by_id, by_text, F.col("text").cast("binary")), lines, f"{by_id} long, {by_text} long, line long, h1 long, h2 long")
    passed = _passing(spread, index.filters, index.shards, [by_id, by_text, "line"])
    found = passed.join(index.common, ["h1", "h2"], "left_semi").groupBy(by_id, by_text).agg(F.collect_set("line").alias(gone))
    met = named.join(found, [by_id, by_text], "left").drop(by_id, by_text)
    return _drop_at(met, names, gone, lambda batch, parts: [set(x or ()) for x in batch.column(batch.schema.get_field_index(gone)).to_pylist()])
