"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are numbers of one text alone. Trees are grown level by level: each level is one
aggregation of gradients by (node, feature, bin) over the binned sample, whose result has a fixed
size. Trees are complete and flattened into arrays, which tasks walk with numpy, all rows of a
slice at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.arrow import map_slices
from termloom.llm.common import cut

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "line_length", "letters", "digits", "upper", "symbols", "white", "wide", "entropy", "symbol_words",
)
BINS = 32
_CLASS = np.zeros((256, 5))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b < 128 and _c.isalpha(), _b < 128 and _c.isdigit(), 65 <= _b <= 90, _b < 128 and not _c.isalnum() and _b > 32 and _c not in ".,;:!?'\"()-", _b in b" \t\n\r\x0b\x0c")
_ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-")


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS; all 0 for a null or empty text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    letters, digits, upper, symbols, white = (share @ _CLASS).tolist()
    used = share[share > 0]
    words = raw.split()
    n, lines = max(1, len(words)), raw.split(b"\n")
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    odd = sum(c for w, c in counts.items() if w.translate(None, _ODD) != w)
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n,
        pairs, len(set(lines)) / len(lines), len(raw) / len(lines), letters, digits, upper, symbols, white, float(share[128:].sum()),
        float(-(used * np.log2(used)).sum()), odd / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2; a row goes right where its value is above `cut`."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, seed: int = 3) -> Trees:
    """Trees from labelled (doc_id, text, label 0/1); labels that are null or NaN are left out.

    max_rows bounds the sample, taken by hash of doc_id with the chance that gives so many rows in
    expectation; their texts are whole. A null text counts as an empty one; repeated rows count again;
    a null doc_id is an id like others; other columns are ignored. With no rows, or one label only, the
    base alone decides. Equal gains go to the first statistic and the lowest limit.
    """
    spark = labelled.sparkSession
    labelled = labelled.filter(F.col("label").isNotNull() & ~F.isnan(F.col("label").cast("double")))
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    inner, width = 2**depth - 1, len(STATISTICS)
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n or ones in (0, n):
        return none
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max_rows / n))

    def measure(batch: pa.RecordBatch) -> dict[str, object]:
        return {"label": batch.column(0), "x": [statistics(t) for t in batch.column(1).to_pylist()]}

    rows = cut(map_slices(sample.select(F.col("label").cast("double"), "text"), measure, "label double, x array<double>"), "quality-sample")
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    edges = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), steps, 2_000) for f in range(width)]).first()
    if edges[0] is None:
        return none
    limits = [np.unique(np.array(e)) for e in edges]  # value v is in bin searchsorted(limits, v): bin b holds v <= limits[b]

    model, grown = none, []
    for _ in range(trees):
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        sums = np.zeros((2 ** (depth + 1), 2))
        for level in range(depth):
            held = spark.sparkContext.broadcast((model, feature.copy(), limit.copy(), limits))

            def histogram(frames: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
                model, feature, limit, limits = held.value
                size = 2**level * width * BINS
                total = np.zeros((size, 2))
                for frame in frames:
                    if not len(frame):
                        continue
                    x, y = np.stack(frame["x"].to_numpy()), frame["label"].to_numpy()
                    p = model.score(x)
                    node = np.zeros(len(x), np.int64)
                    for _ in range(level):
                        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
                    node -= 2**level - 1
                    for f, edge in enumerate(limits):
                        cell = (node * width + f) * BINS + np.searchsorted(edge, x[:, f])
                        total += np.stack([np.bincount(cell, p - y, size), np.bincount(cell, p * (1 - p), size)], axis=1)
                used = np.flatnonzero(total[:, 1])
                yield pd.DataFrame({"cell": used, "g": total[used, 0], "h": total[used, 1]})

            cells = rows.mapInPandas(histogram, "cell long, g double, h double").groupBy("cell").agg(F.sum("g"), F.sum("h")).collect()
            total = np.zeros((2**level * width * BINS, 2))
            for c, g, h in cells:  # nodes x statistics x bins at most
                total[c] = g, h
            total = total.reshape(2**level, width, BINS, 2)
            for k in range(2**level):
                whole = total[k, 0].sum(axis=0)
                left = np.cumsum(total[k], axis=1)
                right = whole - left
                gain = (left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge)) - whole[0] ** 2 / (whole[1] + ridge)
                gain[(left[..., 1] < 1e-3) | (right[..., 1] < 1e-3)] = 0
                gain = np.round(gain, 9)
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                i = 2**level - 1 + k
                if gain[f, b] > 1e-6 and b < len(limits[f]):
                    feature[i], limit[i] = f, limits[f][b]
                    sums[2 * i + 1], sums[2 * i + 2] = left[f, b], right[f, b]
                else:
                    sums[2 * i + 1] = sums[2 * i + 2] = whole
        last = sums[inner : 2 * inner + 1]
        grown.append((feature, limit, -rate * last[:, 0] / (last[:, 1] + ridge)))
        model = Trees(base, *[np.stack(part) for part in zip(*grown)])
    return model


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with `quality_score` (0 to 1; a column of that name is replaced), from the text alone.

    A null text counts as an empty one, whose statistics are all 0. Repeated rows get equal scores,
    other columns are passed on, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))
            yield pd.Series(shared.value.score(x))

    return docs.withColumn("quality_score", score("text"))
