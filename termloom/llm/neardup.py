"""MinHash near-dedup on SetSketch registers.

A document's set is its distinct five-word shingles, as 64-bit hashes. Its sketch holds, for each of
M registers, the least of M exponential values over the set, on a logarithmic scale and cut off at
both ends: registers of a union are the larger of two registers, and registers of similar sets are
often equal. Bands of registers give candidates, the joint likelihood of two sketches estimates
their similarity, and what is left is verified on the full sets.

Documents of equal sets are one class from the start. Classes that share a band are first compared
with one leader each (the class of the least doc_id), so a group of any size costs one comparison
a member. Only what is then still in different components meets again in its bands, in blocks: first
each class with the likeliest partner in another component, then every likely pair of two components,
so that no link between them is left out. In that last step blocks hold a sample of each set too (all
of a set up to SAMPLE shingles), so that of the likely pairs only those leave the task that are, or
in larger sets may be, linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.arrow import map_slices, slices, utf8
from termloom.llm.common import cut

WORDS = 5
BANDS, ROWS = 48, 6
M = BANDS * ROWS
#: SetSketch parameters: base, rate and the largest register value less one.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: A pair is verified where its estimate is at least the threshold less this (5.9 standard errors of M registers at 75 %).
MARGIN = 0.15
#: Up to so many classes (about 120 bytes each in a broadcast, 60 MB) are broadcast to pick texts; more are joined by shuffle.
EVERYWHERE = 500_000
#: Members of one block of a full comparison.
BLOCK = 512
#: Shingles of a set that a block holds in the last step, those of least hash.
SAMPLE = 1024
#: A pair of sampled sets is verified where its sample is at least the threshold less this (four standard errors); of whole sets, less rounding.
SAMPLE_MARGIN, WHOLE_MARGIN = 0.055, 0.001
#: Word hashes that a worker process keeps (about 200 bytes each); it outlives its tasks.
KEPT_HASHES = 100_000
_STEP = 40_000
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ODD = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, M, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_HASHES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a UTF-8 text; of all words where there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join([str(len(words)).encode(), *words]))], np.uint64)
    out = np.zeros(n, np.uint64)
    for i, by in enumerate(_MULTIPLY):
        out += h[i : i + n] * by
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each set; none may be empty."""
    least = np.empty((M, len(sets)), np.uint64)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    joined = np.concatenate(sets)
    for i, odd in enumerate(_ODD):
        np.minimum.reduceat(joined * odd, starts, out=least[i])
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def _sets(texts: list[bytes], hashes: dict[bytes, int]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Positions and sets of the texts with words, in runs of about _STEP shingles."""
    at, sets, held = [], [], 0
    for i, text in enumerate(texts):
        s = shingles(text, hashes)
        if len(s):
            at.append(i)
            sets.append(s)
            held += len(s)
        if held > _STEP:
            yield at, sets
            at, sets, held = [], [], 0
    if at:
        yield at, sets


_HASHES = _Hashes()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, k (128-bit digest of the set; null for an empty one), registers (M 16-bit numbers; null likewise)."""

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        n = batch.num_rows
        sizes, keys, regs = [0] * n, [None] * n, [None] * n
        for at, sets in _sets(utf8(batch.column(1)), _HASHES):
            for i, s, r in zip(at, sets, registers(sets)):
                sizes[i], keys[i], regs[i] = len(s), xxhash.xxh3_128_digest(s.tobytes()), r.tobytes()
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": sizes, "k": keys, "registers": regs}

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", F.col("text").cast("binary"), F.xxhash64("text"))
    return map_slices(columns, make, f"doc_id {kind}, text_hash long, n_shingles long, k binary, registers binary")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sketches a and b (pairs x M) of sets of na and nb elements, from a grid.

    The joint likelihood has the numbers of registers that are larger in a, larger in b and equal.
    """
    up, down = (a > b).sum(axis=-1)[:, None], (a < b).sum(axis=-1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_up, p_down = p(u - v * grid), p(v - u * grid)
    like = up * np.log(np.maximum(p_up, 1e-12)) + down * np.log(np.maximum(p_down, 1e-12)) + (M - up - down) * np.log(np.maximum(1 - p_up - p_down, 1e-12))
    return np.take_along_axis(grid, like.argmax(axis=1)[:, None], 1)[:, 0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of edges (a, b) reaches; alternating large and small stars."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", instead_of=now)


class _Comparer:
    """Verifies pairs of classes on their full sets, after an estimate from their sketches."""

    def __init__(self, docs: DataFrame, classes: DataFrame, share: int) -> None:
        self.docs, self.classes, self.share = docs.select("doc_id", "text"), classes, share

    def _with(self, pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
        """pairs (a, b) with the values of both; a frequent a is split by AQE."""
        for side in ("b", "a"):
            own = values.select(F.col("k").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names])
            pairs = pairs.join(own, side)
        return pairs

    def likely(self, pairs: DataFrame) -> DataFrame:
        least = self.share / 100 - MARGIN

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            a, b = (np.frombuffer(b"".join(column[n].to_pylist()), np.uint16).reshape(-1, M) for n in ("registers_a", "registers_b"))
            keep = pa.array(estimate(a, b, np.asarray(column["n_shingles_a"], float), np.asarray(column["n_shingles_b"], float)) >= least)
            return {"a": column["a"].filter(keep), "b": column["b"].filter(keep)}

        return map_slices(self._with(pairs, self.classes, ["registers", "n_shingles"]), make, "a binary, b binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets have intersection and union as 100 x i >= share x u."""
        held = self.sets(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
        share = self.share

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            keep = []
            for x, y in zip(column["set_a"].to_pylist(), column["set_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = _common(x, y)
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            return {"a": column["a"].filter(pa.array(keep)), "b": column["b"].filter(pa.array(keep))}

        return map_slices(self._with(pairs, held, ["set"]), make, "a binary, b binary")

    def sets(self, wanted: DataFrame, sampled: bool = False) -> DataFrame:
        """(k, set) of the classes k in wanted: sorted 64-bit hashes; sampled: the upper 32 bits of the SAMPLE least ones."""
        ids = cut(self.classes.join(wanted, "k").select("k", "id"), "pair-classes")
        few = ids.count() <= EVERYWHERE
        pick = ids.select(F.col("id").alias("_id"), F.col("k").alias("_k"))
        texts = self.docs.join(F.broadcast(pick) if few else pick, self.docs.doc_id.eqNullSafe(F.col("_id")))

        def make(batch: pa.RecordBatch) -> dict[str, object]:
            keys, out = batch.column(1).to_pylist(), {"k": [], "set": []}
            for at, found in _sets(utf8(batch.column(0)), _HASHES):
                for i, s in zip(at, found):
                    if xxhash.xxh3_128_digest(s.tobytes()) == keys[i]:  # else another row of the same doc_id
                        out["k"].append(keys[i])
                        out["set"].append(((s[:SAMPLE] >> np.uint64(32)).astype(np.uint32) if sampled else s).tobytes())
            return out

        return cut(map_slices(texts.select(F.col("text").cast("binary"), "_k"), make, "k binary, set binary").dropDuplicates(["k"]), "pair-sets")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays without repeats share."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, share: int) -> bool:
    """Whether sets of nx and ny shingles with samples x and y can be linked: exact but for rounding where the samples are whole."""
    whole = nx <= SAMPLE and ny <= SAMPLE
    if not whole:  # the least hashes of the union, as far as both samples reach
        end = min(s[-1] for s, n in ((x, nx), (y, ny)) if n > SAMPLE)
        x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
    both = _common(x, y)
    return both >= (share / 100 - (WHOLE_MARGIN if whole else SAMPLE_MARGIN)) * (len(x) + len(y) - both)


def _cross_pairs(members: DataFrame, classes: DataFrame, share: int, samples: DataFrame | None) -> DataFrame:
    """Likely pairs (a, b) in different components of all members (bucket, band, k, comp, size) of the same bucket, in blocks.

    Without samples: only each class's likeliest partner among those that its block has not yet paired
    it with. With samples (k, set): all pairs that these allow.
    """
    best = samples is None
    held = classes.select("k", "registers", "n_shingles")
    held = held.withColumn("set", F.lit(None).cast("binary")) if best else held.join(samples, "k")
    least = share / 100 - MARGIN
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("k"), F.col("_blocks")).cast("int")
    spread = (
        members.withColumn("_blocks", blocks).withColumn("_own", own).join(held, "k")
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("bucket", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "_own", "k", "comp", "registers", "n_shingles", "band", "set")
    )

    def compare(rows: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        often: dict[bytes, int] = {}
        for r in rows:
            often[r[5]] = often.get(r[5], 0) + 1
        rows = sorted(rows, key=lambda r: (often[r[5]], r[5], r[4]))
        comp = np.unique([r[5] for r in rows], return_inverse=True)[1]
        own, one_block = np.array([r[3] for r in rows]), rows[0][1] == rows[0][2]
        regs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, M)
        sizes = np.array([r[7] for r in rows], float)
        sets = None if best else [np.frombuffer(r[9], np.uint32) for r in rows]
        a, b = [], []
        for i in range(len(rows) - 1):
            js = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if not one_block:
                js = js[own[js] != own[i]]
            js = js[np.minimum(sizes[js], sizes[i]) >= share / 100 * np.maximum(sizes[js], sizes[i]) - 1e-9]
            if len(js):
                same = regs[js] == regs[i]
                first = same.reshape(len(js), BANDS, ROWS).all(axis=2).argmax(axis=1)  # a pair counts in its first common band alone
                js = js[(first == rows[i][8]) & (same.sum(axis=1) >= M * max(0.0, least - MARGIN))]  # the rest is far below any likely pair
            if len(js):
                likely = estimate(np.broadcast_to(regs[i], (len(js), M)), regs[js], np.full(len(js), sizes[i]), sizes[js])
                if best:
                    js = js[[int(likely.argmax())]] if likely.max() >= least else js[:0]
                else:
                    js = [j for j in js[likely >= least] if may_link(sets[i], sets[j], rows[i][7], rows[j][7], share)]
                a += [rows[i][4]] * len(js)
                b += [rows[j][4] for j in js]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if len({r[5] for r in group}) > 1:
                a, b = compare(group)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(a, b)], pa.binary()), pa.array([max(x) for x in zip(a, b)], pa.binary())], ["a", "b"])

        for batch in slices(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != at:
                    yield from done()
                    group, at = [], row[:3]
                group.append(row)
        yield from done()

    return spread.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Two documents are linked where 100 x intersection >= share x union of their sets; component_id
    is the least doc_id that links reach, kept whether it is the row's own. A document without
    words, or without text, is a component of its own. Equal sets are always linked. A pair just at
    75 % shares one of 48 bands with a chance of 0.9999. Repeated rows get equal results; a
    component of null ids alone has a null component_id and is kept. An empty table gives an empty
    result.
    """
    drawn = cut(sketch(docs), "sketches")
    linked = component_map(docs, drawn, share)
    out = drawn.select("doc_id", "text_hash", "n_shingles", "k").join(linked, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, share: int = 75) -> DataFrame:
    """docs with one document of each component of near duplicates, the one of the least doc_id; of repeated rows one.

    Documents without words, or without text, all stay, as do all that have no near duplicate. Rows of
    one id and one text count as repeated, whatever their other columns hold; which of them stays is
    not fixed. Rows with a null id stay where their component has no other. All columns are passed
    on, whatever their names. An empty table gives an empty result. Ids of the rows that stay meet
    their texts in a join by shuffle: they grow with the input, so they are not broadcast.
    """
    found = near_duplicates(docs, share).filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    found = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_rows"), "kept-documents")
    repeated = found.agg(F.coalesce(F.max("_rows") > 1, F.lit(False))).first()[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    # every id is present on both sides; null ids meet as one value
    key = [F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("")).alias("_key"), "_hash"]
    kept = rows.select("row", *key).join(found.select(*key).hint("merge"), ["_key", "_hash"], "left_semi")
    kept = kept.dropDuplicates(["_key", "_hash"]) if repeated else kept
    return kept.select("row.*")


def _buckets_of(regs: str) -> Column:
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col(regs), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))


def component_map(docs: DataFrame, drawn: DataFrame, share: int) -> DataFrame:
    """(k, component_id) for each class of equal sets."""
    classes = cut(
        drawn.filter("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "set-classes",
    )
    banded = classes.select("k", "id", _buckets_of("registers").alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "k")).alias("lead")).filter("size > 1")
    members = cut(banded.join(full, "bucket").select("bucket", "band", "k", "id", "size", "lead"), "band-members")
    comparer = _Comparer(docs, classes, share)
    pairs = members.filter("k != lead.k").groupBy("k").agg(F.min("lead").alias("lead")).select(F.least("lead.k", "k").alias("a"), F.greatest("lead.k", "k").alias("b"))
    tested = cut(comparer.likely(pairs.distinct()), "leader-pairs")
    links = cut(comparer.links(tested), "links")
    labels = components(links)
    mixed = members.select("bucket", "band", "k", "size")
    for best in (True, False):
        named = mixed.join(labels, F.col("k") == F.col("node"), "left").select("bucket", "band", "k", "size", F.coalesce("label", "k").alias("comp"))
        split = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
        named = cut(named.join(split.select("bucket"), "bucket"), "mixed-members")
        mixed = named.select("bucket", "band", "k", "size")
        if named.isEmpty():
            break
        samples = None if best else comparer.sets(named.select("k").distinct(), sampled=True)
        pairs = cut(_cross_pairs(named, classes, share, samples).join(tested, ["a", "b"], "left_anti"), "cross-pairs")
        tested = tested.unionByName(pairs)
        links = cut(links.unionByName(comparer.links(pairs)), "links")
        labels = components(links)
    found = classes.select("k", "id").join(labels, F.col("k") == F.col("node"), "left").select("k", "id", F.coalesce("label", "k").alias("label"))
    least = found.groupBy("label").agg(F.min("id").alias("component_id"))
    return found.join(least, "label").select("k", "component_id")
