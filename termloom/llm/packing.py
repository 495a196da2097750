"""Best-fit packing of token sequences by exact-complement hashing.

How many pieces there are of each length (at most `size` numbers, whatever the input) is all that
the plan needs. An index holds the sums of one, two and three lengths. From the longest length down,
the gap that a piece leaves is looked up in it, and the combinations that fill it exactly are used as
often as the counts of their lengths allow. What no combination fills exactly is placed by
best fit, still by length and count. The plan says which ranks of each length go to which sequences;
pieces are numbered within their length in two levels, so that a frequent length is no hot group.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.arrow import map_slices, utf8
from termloom.llm.common import cut, free_names, rows_each, running

SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of a byte-level BPE given as a `tokenizers` file, with the same vocabulary as ranks beside it.

    Both libraries give the same ids for ordinary text (tested on all documents of a driver table);
    the rank form is four times as fast. A text with the special token's string goes to `tokenizers`, as does every text where the
    rank file is missing.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.fast = tokenizers.Tokenizer.from_file(path), None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then end_id; a null text is an empty one, and an empty one is end_id
    alone. Only a document longer than `size` is cut: every piece but the first has `size` ids.
    Repeated rows and null ids give pieces of their own. Other columns are ignored. An empty table
    gives an empty result.
    """

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        encode, rows = encoder(tokenizer), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*encode(text or ""), end_id], "<u4")
            first = (len(ids) - 1) % size + 1
            for piece, end in enumerate(range(first, len(ids) + 1, size)):
                start = max(0, end - size)
                rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """What fills a gap exactly: every sum of one, two or three lengths that pieces have, with the combinations that make it.

    Built once. A triple is kept as its longest length and the pair sum that it leaves, so the index
    has about size squared entries. Counts only fall, so what is used up is passed by for good: each
    gap reads its combinations once, singles first, then pairs, then triples, longer lengths first.
    """

    def __init__(self, counts: np.ndarray, size: int) -> None:
        self.counts = counts
        lengths = np.flatnonzero(counts)[::-1].tolist()  # from the longest
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < size:
                    self.pairs.setdefault(a + b, []).append((a, b))
        self.triples: dict[int, list[int]] = {}
        for a in lengths:
            for rest, held in self.pairs.items():
                if a + rest < size and held[-1][0] <= a:  # its last pair has the shortest longer length
                    self.triples.setdefault(a + rest, []).append(a)
        self._unread: dict[int, Iterator[tuple[int, ...]]] = {}

    def _combinations(self, total: int) -> Iterator[tuple[int, ...]]:
        if self.counts[total]:
            yield (total,)
        for a, b in self.pairs.get(total, ()):
            yield a, b
        for a in self.triples.get(total, ()):
            for b, c in self.pairs[total - a]:
                if not self.counts[a]:
                    break
                if b <= a:
                    yield a, b, c

    def fill(self, gap: int, length: int) -> tuple[tuple[int, ...], int] | None:
        """The first combination that fills the gap, and how often it and `length` can be had; gap and length go together."""
        unread = self._unread.setdefault(gap, self._combinations(gap))
        for extra in unread:
            if all(self.counts[x] for x in extra):
                n = min(int(self.counts[x]) // k for x, k in Counter((length, *extra)).items())
                if n:
                    return extra, n
        return None


def packing_plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences). counts[x]: pieces of length x, 1 <= x <= size."""
    counts, plan = counts.astype(np.int64).copy(), []
    if counts[size]:
        plan.append(((size,), int(counts[size])))
        counts[size] = 0
    index = SumIndex(counts, size)
    for length in range(size - 1, 0, -1):
        while counts[length] and (found := index.fill(size - length, length)):
            for x in (length, *found[0]):
                counts[x] -= found[1]
            plan.append(((length, *found[0]), found[1]))
    # best fit of the rest; open sequences by the room that is left in them
    rooms: list[int] = []
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = size - sum(lengths)
        if room not in open_at:
            bisect.insort(rooms, room)
            open_at[room] = []
        open_at[room].append((lengths, n))

    for length in range(size - 1, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(size // length, left)
                put((length,) * each, left // each)
                left %= each
                continue
            room = rooms[at]
            lengths, n = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
                del open_at[room]
            used = min(n, left)
            if n > used:
                put(lengths, n - used)
            put((*lengths, length), used)
            left -= used
    plan += [x for group in open_at.values() for x in group]
    return plan


@dataclass(frozen=True)
class _Places:
    """Sorted keys (length, first rank) of the plan's intervals, and the sequence and offset of each."""

    keys: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, plan: list[tuple[tuple[int, ...], int]]) -> _Places:
        taken: Counter[int] = Counter()
        rows, sequence = [], 0
        for lengths, n in plan:
            offset = 0
            for x in lengths:
                rows.append((x, taken[x], sequence, offset))
                taken[x] += n
                offset += x
            sequence += n
        rows.sort()
        made = np.array(rows, np.int64).reshape(-1, 4)
        return cls(cls.key(made[:, 0], made[:, 1]), made[:, 1], made[:, 2], made[:, 3])

    @staticmethod
    def key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 46) + rank


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces (with length, 1 to size) and sequence_id, offset: as few sequences as the plan finds.

    Rows with a null length, or one outside 1 to size, raise an error. Equal pieces are told apart by
    a row number. Columns sequence_id and offset are replaced; all others are passed on, whatever their
    names. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    row, bucket, order = free_names(pieces, "_p_row", "_p_bucket", "_p_rank")
    base = cut(pieces.withColumn(row, F.monotonically_increasing_id()), "pack-pieces")
    counts = np.zeros(size + 1, np.int64)
    bad = F.col("length").isNull() | ~F.col("length").between(1, size)
    for length, n in base.groupBy(F.when(bad, F.lit(-1)).otherwise(F.col("length"))).count().collect():  # size + 1 rows at most
        if length < 0:
            raise ValueError(f"{n} pieces have no length between 1 and {size}")
        counts[length] = n
    places = spark.sparkContext.broadcast(_Places.of(packing_plan(counts, size)))
    # a length has buckets by its own count, so that rare ones make few totals
    each = rows_each(spark, int(counts.sum()))
    buckets = F.from_json(F.lit(json.dumps([max(1, -(-int(n) // each)) for n in counts])), "array<int>")
    spread = base.withColumn(bucket, F.pmod(F.xxhash64(row), F.get(buckets, F.col("length").cast("int"))))
    ranked = running(spread, "length", bucket, [row], F.lit(1), order).drop(bucket, row)
    keep = list(pieces.schema)

    def place(batch: pa.RecordBatch) -> dict[str, object]:
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        held, length, rank = places.value, np.asarray(column["length"], np.int64), np.asarray(column[order], np.int64)
        at = np.searchsorted(held.keys, held.key(length, rank), side="right") - 1
        return column | {"sequence_id": pa.array(held.sequences[at] + rank - held.ranks[at]), "offset": pa.array(held.offsets[at])}

    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_slices(ranked.select(*[F.col(f"`{f.name}`") for f in keep], order), place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """All pieces of docs (doc_id, text) with their place in a sequence; any doc_id may be null or repeat."""
    return pack(token_pieces(docs, tokenizer, end_id, size), size)
