"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case-folded, with runs of white space as one space and none at the
ends. Its fingerprint is the 128-bit xxhash of that form. Documents that share a digest are
compared byte by byte (edited texts by the SHA-256 of their forms); if forms differ after all, the
digest gets a suffix, so that equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.arrow import map_slices, slices
from termloom.llm.common import BROADCAST_BYTES, buckets_for, cut, small_frame

#: Ranges of documents in order, at most: percentiles are no finer.
MAX_RANGES = 65_536
DIGITS = 32


def canonical(text: str | None) -> bytes:
    """The canonical form as UTF-8; a null text is an empty one."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes, digits: int = DIGITS) -> str:
    return xxhash.xxh3_128_hexdigest(form)[:digits]


@lru_cache(4)
def _signed(text: str | None, digits: int) -> tuple[bytes, str, bytes]:
    """Form, digest and SHA-256; the few last ones are kept: a text is met again as its neighbour's successor."""
    form = canonical(text)
    return form, digest(form, digits), hashlib.sha256(form).digest()


def fingerprint(docs: DataFrame, digits: int = DIGITS, shared_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a row of docs: doc_id, fingerprint.

    Equal texts, and texts that differ only in normal form, case or white space, have equal
    fingerprints and no others do. Null and empty texts share one. Repeated rows and null ids are rows
    of their own; other columns are ignored. An empty table gives an empty result. Groups of copies
    meet as digests only; of the canonical texts in a group each task keeps one, so that a group of
    any size compares without gathering its texts. digits shortens the digest.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(batch: pa.RecordBatch) -> dict[str, object]:
        made = [_signed(x, digits) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fingerprint": [x[1] for x in made], "form_sha": [x[2] for x in made]}

    plain = cut(map_slices(docs.select("doc_id", "text"), digests, f"doc_id {kind}, fingerprint string, form_sha binary"), "digests")
    signed = plain.select("fingerprint", "form_sha")
    return _told_apart(plain, collisions(docs, signed, signed, digits, shared_bytes), [("fingerprint", "form_sha")]).drop("form_sha")


def collisions(docs: DataFrame, own: DataFrame, signed: DataFrame, digits: int = DIGITS, shared_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(fingerprint, form_sha, suffix): the canonical forms of digests that more than one form has.

    own has the digests of docs, signed those and any others (fingerprint, form_sha). Digests that
    several rows share are sent to the tasks by their leading 64 bits where that is within
    shared_bytes; beyond, the forms of all texts meet them in a join.
    """
    spark = docs.sparkSession
    shared = cut(own.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "shared-digests")
    few = shared.count() * 8 <= shared_bytes
    heads = shared.select(F.conv(F.rpad(F.substring("fingerprint", 1, 15), 15, "0"), 16, 10).cast("long").alias("head")) if few else None
    known = spark.sparkContext.broadcast(np.unique(heads.toArrow().column("head").to_numpy()) if few else None)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shared digest with one canonical form a task: its copies are compared here and left out."""
        wanted, seen, held = known.value, {}, 0
        for batch in slices(batches):
            out: list[tuple[str, bytes]] = []
            made = [canonical(text) for text in batch.column(0).to_pylist()]
            keys = [digest(form, digits) for form in made]
            if wanted is not None:
                at = np.array([int(k[:15].ljust(15, "0"), 16) for k in keys], np.int64)
                hits = wanted[np.minimum(np.searchsorted(wanted, at), max(0, len(wanted) - 1))] == at if len(wanted) else np.zeros(len(at), bool)
                chosen = np.flatnonzero(hits).tolist()
            else:
                chosen = range(len(keys))
            for i in chosen:
                small = zlib.compress(made[i], 1)  # equal bytes have equal compressed bytes and no others do
                if seen.get(keys[i]) == small:
                    continue
                out.append((keys[i], small))
                if held < 64_000_000:
                    seen[keys[i]] = small
                    held += len(small)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], ["fingerprint", "form"])

    made = docs.select("text").mapInArrow(forms, "fingerprint string, form binary")
    if not few:
        made = made.join(shared, "fingerprint", "left_semi")
    several = lambda df, c: df.groupBy("fingerprint").agg(F.min(c).alias("_low"), F.max(c).alias("_high")).filter("_low != _high").select("fingerprint")
    odd = cut(several(made, "form").unionByName(several(signed, "form_sha")).distinct(), "odd-digests")
    order = Window.partitionBy("fingerprint").orderBy("form_sha")
    return cut(signed.join(odd, "fingerprint").distinct().withColumn("suffix", F.row_number().over(order)), "digest-clashes")


def _told_apart(df: DataFrame, clashes: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """df with a suffix to each fingerprint column where its digest stands for several forms."""
    if clashes.isEmpty():
        return df
    order = df.columns
    for column, sha in columns:
        named = clashes.select(F.col("fingerprint").alias(column), F.col("form_sha").alias(sha), "suffix")
        df = df.join(named, [column, sha], "left").withColumn(column, F.concat_ws("-", column, F.col("suffix").cast("string"))).drop("suffix")
    return df.select(order)


def edited_text(text: str | None, following: str | None) -> str:
    """The last floor(n / 2) characters of text replaced by the first as many (or all) of the following one."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_in_order(docs: DataFrame, make: Callable[[object, str | None, str | None], tuple], schema: str) -> DataFrame:
    """make(doc_id, text, next text) for every document and the next by descending doc_id; after the last comes the first.

    Documents are dealt into ranges of doc_id. The first document of each range is dealt a second
    time, to the end of the range before, so that every task streams through its sorted rows and
    sees each successor without holding more than two texts. Rows of equal doc_id are ordered by
    text; null ids come last, in the last range. Only the bounds of the ranges and their first ids
    meet the driver; ranges grow with the rows, up to MAX_RANGES. doc_id must be a whole number.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number: documents are ordered by it in ranges")
    rows, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(MAX_RANGES, buckets_for(spark, rows))
    steps = F.from_json(F.lit(json.dumps([i / ranges for i in range(1, ranges)])), "array<double>")
    bounds = docs.select(F.percentile_approx("doc_id", steps, max(10_000, 4 * ranges))).first()[0]
    bounds = sorted(set(bounds or []), reverse=True)
    # cells of equal width, each with the bounds inside it and the number of bounds in higher cells
    low, width = low or 0, max(1.0, ((high or 0) - (low or 0) + 1) / ranges)
    inside: dict[int, list[int]] = {}
    for b in bounds:
        inside.setdefault(math.floor((b - low) / width), []).append(b)
    cells, higher = [], 0
    for c in range(ranges, -1, -1):
        cells.append({"_cell": c, "_base": higher, "_inner": inside.get(c, [])})
        higher += len(inside.get(c, []))
    grid = F.broadcast(small_frame(spark, cells, "_cell bigint, _base int, _inner array<bigint>"))
    place = F.col("_base") + F.size(F.filter("_inner", lambda b: b > F.col("doc_id")))
    dealt = (
        docs.select("doc_id", "text", F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).alias("_cell"))
        .join(grid, "_cell", "left")
        .select("doc_id", "text", F.coalesce(place, F.lit(len(bounds))).alias("_range"))
    )
    heads = sorted(tuple(r) for r in dealt.groupBy("_range").agg(F.max("doc_id")).collect())  # one row a range
    if not heads:
        return spark.createDataFrame([], schema)
    before = [heads[-1][0], *[r for r, _ in heads[:-1]]]
    leads = [{"_range": r, "_head": h, "_to": to} for (r, h), to in zip(heads, before)]
    leads = F.broadcast(small_frame(spark, leads, "_range int, _head bigint, _to int"))
    own, copy = F.struct(F.col("_range").alias("at"), F.lit(0).alias("late")), F.struct(F.col("_to").alias("at"), F.lit(1).alias("late"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("_head")), F.array(own, copy)).otherwise(F.array(own))
    spread = dealt.join(leads, "_range").select("doc_id", "text", F.inline(places))
    lined = spread.repartition(len(heads), "at").sortWithinPartitions("at", "late", F.col("doc_id").desc_nulls_last(), "text")

    wanted = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, last = to_arrow_schema(wanted), None
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text, at, late in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and last[2] == at:
                    rows.append(make(last[0], last[1], text))
                last = None if late else (doc_id, text, at)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return lined.mapInArrow(run, schema)


def fingerprint_edits(docs: DataFrame, digits: int = DIGITS, shared_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    A digest is equal or it is not: the likenesses are 1 where the canonical forms are equal byte by
    byte and else 0. Nulls are empty texts; repeated rows and null ids give rows of their own; of one
    document alone the next is itself; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(doc_id: object, text: str | None, following: str | None) -> tuple:
        edited = edited_text(text, following)
        (own, own_key, own_sha), (after, _, _), (changed, changed_key, changed_sha) = (_signed(x, digits) for x in (text, following, edited))
        return doc_id, len(text or ""), hashlib.sha256(edited.encode()).hexdigest(), own_key, changed_key, float(own == changed), float(own == after), own_sha, changed_sha

    columns = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    plain = cut(next_in_order(docs, make, columns + ", form_sha binary, edited_form_sha binary"), "fingerprints")
    own = plain.select("fingerprint", "form_sha")
    signed = own.unionByName(plain.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_form_sha").alias("form_sha")))
    clashes = collisions(docs, own, signed, digits, shared_bytes)
    return _told_apart(plain, clashes, [("fingerprint", "form_sha"), ("edited_fingerprint", "edited_form_sha")]).drop("form_sha", "edited_form_sha")
