"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by a forward pass; that of a text is the
product over its words (runs of letters, lower-cased). Piece probabilities are fitted by
expectation maximisation on the word counts of a bounded sample of labelled documents. What the
driver gathers has one row a piece and language at most.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.arrow import map_slices
from termloom.llm.common import cut, free_names

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = "und"
#: Words whose scores a task keeps.
KEPT_WORDS = 100_000
#: Texts whose new words are scored together.
TEXTS = 256
#: A pass brings its sums back to 1 after so many letters, so that none leaves the range of a double; letters that are laid out at once.
RESCALE, LAID_OUT = 8, 256


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return sorted({model.id_to_piece(i).lower() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))} - {""})


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    priors: list[float]  # logarithms
    #: every prefix of a piece; its probability in each language if it is a piece itself, else None
    prefixes: dict[str, tuple[float, ...] | None]
    floor: float  # of a character that is no piece

    @classmethod
    def of(cls, languages: list[str], priors: list[float], pieces: list[str], weights: np.ndarray, floor: float = 1e-7) -> LanguageModel:
        """weights: pieces x languages, not yet scaled."""
        scaled = (weights + 0.01) / (weights + 0.01).sum(axis=0)
        prefixes: dict[str, tuple[float, ...] | None] = {}
        for piece, row in zip(pieces, scaled.tolist()):
            for i in range(1, len(piece)):
                prefixes.setdefault(piece[:i])
            prefixes[piece] = tuple(row)
        return cls(languages, priors, prefixes, floor)

    @cached_property
    def _rows(self) -> tuple[dict, np.ndarray, int]:
        """A tree of the pieces' letters: letter -> (row, further letters), row 0 where no piece ends; the rows' probabilities (the last is the floor's), and the longest piece."""
        root, rows = {}, [(0.0,) * len(self.languages)]
        for prefix, p in sorted(self.prefixes.items(), key=lambda x: len(x[0])):
            node = root
            for letter in prefix[:-1]:
                node = node[letter][1]
            node[prefix[-1]] = (len(rows) if p is not None else 0, {})
            if p is not None:
                rows.append(p)
        return root, np.array([*rows, (self.floor,) * len(self.languages)]), max(map(len, self.prefixes), default=1)

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations; one forward pass for all words of a length.

        The pass keeps the sums of the last few letters only, and scales them for each word and language on its own: words of any length follow one law.
        """
        out = np.empty((len(words), len(self.languages)))
        tree, p, longest = self._rows
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        for n, at in by_length.items():
            texts, wide = [START + words[i] for i in at], min(n, longest)
            ahead = np.zeros((wide + 1, len(at), len(self.languages)))  # of letter a in row a % (wide + 1)
            ahead[0] = 1
            logs = np.zeros((len(at), len(self.languages)))
            for first in range(0, n, LAID_OUT):
                last = min(n, first + LAID_OUT)
                steps = self._steps(texts, first, last, wide, tree, len(p) - 1)
                for a in range(first, last):
                    here = ahead[a % (wide + 1)]
                    if a % RESCALE == RESCALE - 1:  # never 0: each letter has a way to the next
                        scale = here.copy()
                        logs += np.log(scale)
                        ahead /= scale
                    for k in range(min(wide, n - a)):
                        if steps[a - first, k].any():
                            ahead[(a + k + 1) % (wide + 1)] += here * p[steps[a - first, k]]
                    here[...] = 0
            out[at] = np.log(ahead[n % (wide + 1)]) + logs
        return out

    @staticmethod
    def _steps(texts: list[str], first: int, last: int, wide: int, tree: dict, floor: int) -> np.ndarray:
        """(letter, piece length - 1, word) -> row of the piece that begins at the letter; 0 where there is none."""
        where, what, width = [], [], len(texts)
        for column, text in enumerate(texts):
            for a in range(first, last):
                at = (a - first) * wide * width + column
                row, further = tree.get(text[a], (0, None))
                where.append(at)
                what.append(row or floor)
                if further:
                    for letter in text[a + 1 : a + wide]:
                        found = further.get(letter)
                        if found is None:
                            break
                        at += width
                        row, further = found
                        if row:
                            where.append(at)
                            what.append(row)
        steps = np.zeros((last - first) * wide * width, np.int64)
        steps[where] = what
        return steps.reshape(last - first, wide, width)

    def word(self, word: str) -> list[float]:
        return self.words([word])[0].tolist()


def expected_pieces(model: LanguageModel, language: int, word: str) -> dict[str, float]:
    """How often each piece is expected in the word, over all its segmentations in one language.

    Sums are brought back to 1 where they become small, with the logarithm of what was taken out, so that no word is too long.
    """
    text, n = START + word, len(word) + 1
    starts: list[list[tuple[int, str, float]]] = []
    for i in range(n):
        edges = []
        for j in range(i + 1, n + 1):
            part = text[i:j]
            known = part in model.prefixes
            p = model.prefixes[part] if known else None
            if p is not None:
                edges.append((j, part, p[language]))
            elif j == i + 1:
                edges.append((j, "", model.floor))
            if not known:
                break
        starts.append(edges)
    ahead, lift, log, far = [1.0] + [0.0] * n, [0.0] * (n + 1), 0.0, 0
    for i, edges in enumerate(starts):
        if ahead[i] < 1e-100:
            scale = ahead[i]
            log += math.log(scale)
            for j in range(i, far + 1):
                ahead[j] /= scale
        lift[i] = log
        for j, _, p in edges:
            ahead[j] += ahead[i] * p
            far = max(far, j)
    lift[n] = log
    behind, fall = [0.0] * n + [1.0], [0.0] * (n + 1)  # each with its own logarithm
    for i in range(n - 1, -1, -1):
        log = fall[i + 1]
        here = sum(behind[j] * p if fall[j] == log else behind[j] * math.exp(fall[j] - log) * p for j, _, p in starts[i])
        behind[i], fall[i] = (1.0, log + math.log(here)) if here < 1e-100 else (here, log)
    out: dict[str, float] = {}
    for i, edges in enumerate(starts):
        for j, part, p in edges:
            if part:
                x = ahead[i] * p * behind[j] / ahead[n]
                out[part] = out.get(part, 0.0) + (x if lift[i] + fall[j] == lift[n] else x * math.exp(lift[i] + fall[j] - lift[n]))
    return out


def train(docs: DataFrame, pieces: list[str], docs_each: int = 1_000, rounds: int = 2, seed: int = 5) -> LanguageModel | None:
    """Fits piece probabilities from docs (text, lang, doc_id); None without a labelled word.

    docs_each bounds the sample: a language's documents are taken by hash with the chance that gives
    so many in expectation; their texts and words are whole. Null texts and languages are left out;
    repeated rows count again; a null doc_id is an id like others; other columns are ignored. An
    empty table, or one whose labelled texts hold no letter, gives None.
    """
    spark = docs.sparkSession
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_each / n))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < chance[F.col("lang")] * 1_000_000)

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.update((lang, w) for w in WORD.findall(text.lower()))
        return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    words = cut(map_slices(sample.select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    if words.isEmpty():
        return None
    place, number = {p: i for i, p in enumerate(pieces)}, {x: i for i, x in enumerate(languages)}
    weights = np.ones((len(pieces), len(languages)))
    priors = [0.0] * len(languages)
    for _ in range(rounds + 1):
        model = LanguageModel.of(languages, priors, pieces, weights)
        shared = spark.sparkContext.broadcast(model)  # one row a piece

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[str, str], float] = {}
            for frame in frames:
                for lang, word, n in zip(frame["lang"], frame["word"], frame["n"]):
                    for piece, x in expected_pieces(shared.value, number[lang], word).items():
                        sums[lang, piece] = sums.get((lang, piece), 0.0) + n * x
            yield pd.DataFrame({"lang": [k[0] for k in sums], "piece": [k[1] for k in sums], "weight": list(sums.values())})

        found = words.mapInPandas(expect, "lang string, piece string, weight double").groupBy("lang", "piece").agg(F.sum("weight").alias("weight"))
        weights = np.zeros((len(pieces), len(languages)))
        for lang, piece, x in found.collect():  # one row a language and piece at most
            weights[place[piece], number[lang]] = x
    return LanguageModel.of(languages, priors, pieces, weights)


class _Words:
    """Words -> rows of a matrix of log probabilities; row 0 is all zeros, for runs without a letter."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.rows, self.place = model, np.zeros((1, len(model.languages))), {}

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        real = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        self.place |= dict.fromkeys(new, 0)
        self.place |= zip(real, range(len(self.rows), len(self.rows) + len(real)))
        if real:
            self.rows = np.concatenate([self.rows, self.model.words(real)])


def identify(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the columns `names`: language and score (columns of these names are replaced); only text is looked at.

    score is the posterior of the language among the model's. A null text, one without a letter, and
    every text where there is no model, gets `und` and 0. Ties go to the language that sorts first.
    Repeated rows get equal results, other columns are passed on, and an empty table gives an empty
    result.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumn(names[0], F.lit(UNKNOWN)).withColumn(names[1], F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        held = _Words(model)
        for texts in batches:
            out = []
            for start in range(0, len(texts), TEXTS):
                parts = [WORD.findall(t.lower()) if t else [] for t in texts.iloc[start : start + TEXTS]]
                if len(held.place) > KEPT_WORDS:
                    held = _Words(model)
                held.add(set().union(*parts))
                for part in parts:
                    rows = np.fromiter(map(held.place.__getitem__, part), np.int64, len(part))
                    if not rows.any():
                        out.append((UNKNOWN, 0.0))
                        continue
                    total = held.rows[rows].sum(axis=0) + model.priors
                    best = int(total.argmax())
                    out.append((model.languages[best], 1 / float(np.exp(total - total[best]).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    (made,) = free_names(docs, "_made")
    found = docs.withColumn(made, predict("text"))
    return found.withColumn(names[0], F.col(made)["lang_pred"]).withColumn(names[1], F.col(made)["score"]).drop(made)
