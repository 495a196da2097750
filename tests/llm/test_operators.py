"""The corpus operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import langid, mixing, quality, topk
from termloom.llm.cuckoo import CuckooFilter
from termloom.llm.fingerprints import canonical, digest, edited_text, fingerprint, fingerprint_edits
from termloom.llm.linededup import LineIndex, build_filters, drop_common_lines, line_keys, update_filters
from termloom.llm.mixing import mix_sources, mixed_documents, source_schedule
from termloom.llm.neardup import M, SAMPLE, estimate, keep_one_of_each, may_link, near_duplicates, registers
from termloom.llm.packing import Encoder, SumIndex, encoder, pack, pack_documents, packing_plan
from termloom.llm.queries import URL_RULES, public_file
from termloom.llm.sharding import communication_matrix, hypergeometric, shard_documents, shard_rows
from termloom.llm.topk import exact_products, integer_vectors, top_k
from termloom.llm.urls import DIM, filter_urls, match_rules, score_urls, train, url_parts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a river stone cloud paper green seven quiet under morning glass window letter".split()


def make_docs(n: int = 60) -> list[tuple]:
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        words = rng.choice(WORDS, int(rng.integers(3, 40))).tolist()
        text = " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]) + ("\n  Shared LINE \t" if i % 3 else "\nshared line")
        out.append((i, text, "en", f"s{i % 4}" if i % 7 else None, len(text)))
    base = " ".join(rng.choice(WORDS, 60).tolist())
    out += [(n, base, "en", "s0", 0), (n + 1, base + " end", "en", "s1", 0), (n + 2, base, "de", "s1", 0), (n + 3, None, None, None, None), (n + 4, "", "en", "s0", 0), (n + 5, " \n\n ", "en", "s0", 3)]
    out += [out[0], (n + 6, "Ünï ünï " * 4000, "en", "s2", 0)]  # a repeated row and a long text
    return out


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(make_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], DOCS)


# op1


def test_urls(spark) -> None:  # noqa: ANN001
    urls = ["http://A.Example.NET/en/1?x", "https://example.com/de/", "http://x.org/fr", "http://x.org/fr/y", "nonsense", None, "ftp://b.net", "http://é.com/" + "ü" * 3000, "http://b.com?q=http://c.net/", "http://notexample.com/de/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    got = filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(urls) * 3
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0])) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.p_block > 0.5 else "allow")
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_long_rule_lists_are_joined(spark) -> None:  # noqa: ANN001
    urls = spark.createDataFrame([("http://a.b.h7.net/x/1",), ("http://h8.net/",), ("http://z.org/",), (None,)], "url string")
    host, path = url_parts(F.col("url"))
    parts = urls.withColumn("host", host).withColumn("path", path)
    listed = [("block", f"h{i}.net", "/") for i in range(1200)] + [("allow", "b.h7.net", "/x/")]
    joined = match_rules(parts, spark.createDataFrame(listed, "verdict string, host string, path string"))
    plain = match_rules(parts, listed)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select("url", "rule", "rule_verdict").collect())))
    assert key(joined) == key(plain)


def test_url_columns_of_working_names_stay(spark) -> None:  # noqa: ANN001
    odd = spark.createDataFrame([("http://a.net/", 1, 2, "x")], "url string, _grams int, _best int, verdict string")
    row = filter_urls(odd, URL_RULES).first()
    assert (row._grams, row._best, row.verdict, row.rule) == (1, 2, "block", "net/")


def test_url_training_by_hand(spark) -> None:  # noqa: ANN001
    """The weights of the DataFrame steps against the same steps in numpy, and urls that no rule names, held out."""
    rng = np.random.default_rng(1)
    word = lambda bad: "".join(rng.choice(list("xqz" if bad else "aeimnrst"), 6))
    rows = [(f"{word(i % 3 == 0)}.example", f"/{word(i % 3 == 0)}", float(i % 3 == 0)) for i in range(240)]
    urls = spark.createDataFrame(rows, "host string, path string, label double")
    got = train(urls.limit(160), steps=6)
    from termloom.llm.urls import buckets

    x = np.zeros((160, DIM + 1))
    held = urls.limit(160).select("label", buckets(F.col("host"), F.col("path")).alias("b")).collect()
    for i, r in enumerate(held):
        x[i, 0], x[i, r.b] = 1, 1 / np.sqrt(max(1, len(r.b)))
    y, w = np.array([r.label for r in held]), np.zeros(DIM + 1)
    ahead, before = w, w
    for step in range(6):
        w = ahead - 2.0 * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / 160 + 1e-4 * ahead)
        ahead, before = w + step / (step + 3) * (w - before), w
    assert np.abs(np.array(got) - w).max() < 1e-4
    test = urls.exceptAll(urls.limit(160))
    scored = score_urls(test, train(urls.limit(160))).collect()
    assert sum((r.p_block > 0.5) == (r.label > 0.5) for r in scored) >= 0.95 * len(scored)


# op2


@pytest.fixture(scope="module")
def pieces() -> list[str]:
    return langid.vocabulary(public_file("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations() -> None:
    rng = np.random.default_rng(0)
    names = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    model = langid.LanguageModel.of(["x", "y"], [0.0, 0.0], names, rng.random((len(names), 2)))

    def brute(text: str) -> np.ndarray:
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(text) + 1):
            p = model.prefixes.get(text[:n])
            if p is None and n == 1:
                p = (model.floor,) * 2
            if p is not None:
                total = total + np.array(p) * brute(text[n:])
        return total

    for word in ("abab", "babaab", "c", "acb", "aaaaaa"):
        want = np.log(brute("▁" + word))
        assert np.allclose(model.word(word), want) and np.allclose(model.words([word])[0], want)
        expected = langid.expected_pieces(model, 0, word)
        assert sum(len(k) * v for k, v in expected.items()) <= len(word) + 1 + 1e-9
    assert np.isfinite(model.word("ab" * 5000)).all()


def test_words_of_any_length_follow_one_law() -> None:
    """Against sums in whole fractions: lengths about every former limit, pieces of very unequal weight, and letters that no piece knows."""
    names = ["▁", "a", "b", "ab", "ba", "aba"]
    for weights in (np.random.default_rng(1).random((6, 2)), np.array([[1e10, 1.0]] + [[0.0, 0.0]] * 5)):
        model = langid.LanguageModel.of(["x", "y"], [0.0, 0.0], names, weights)

        def exact(text: str, language: int) -> tuple[Fraction, dict[str, Fraction]]:
            n = len(text)
            edges = []
            for i in range(n):
                for j in range(i + 1, min(n, i + 3) + 1):
                    p = model.prefixes.get(text[i:j])
                    if p is not None or j == i + 1:
                        edges.append((i, j, text[i:j] if p is not None else "", Fraction(p[language] if p is not None else model.floor)))
            ahead, behind = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
            for i, j, _, p in edges:
                ahead[j] += ahead[i] * p
            for i, j, _, p in reversed(edges):
                behind[i] += behind[j] * p
            out: dict[str, Fraction] = {}
            for i, j, part, p in edges:
                if part:
                    out[part] = out.get(part, Fraction(0)) + ahead[i] * p * behind[j] / ahead[n]
            return ahead[n], out

        def log(x: Fraction) -> float:
            return math.log2(x.numerator >> max(0, x.numerator.bit_length() - 900)) * math.log(2) + max(0, x.numerator.bit_length() - 900) * math.log(2) - (math.log2(x.denominator >> max(0, x.denominator.bit_length() - 900)) + max(0, x.denominator.bit_length() - 900)) * math.log(2)

        words = [("abacbab" * 40)[:n] for n in (1, 7, 8, 9, 37, 38, 39, 40, 41, 42, 80, 250)] + ["c" * 38, "c" * 60 + "ab", "a" + "c" * 240]
        found = model.words(words)
        for word, row in zip(words, found):
            for language in (0, 1):
                total, pieces = exact("▁" + word, language)
                assert math.isclose(row[language], log(total), rel_tol=1e-9)
                expected = langid.expected_pieces(model, language, word)
                assert expected.keys() == pieces.keys() and all(math.isclose(expected[k], float(v), rel_tol=1e-6, abs_tol=1e-12) for k, v in pieces.items())


def test_expectation_maximisation_by_hand(spark) -> None:  # noqa: ANN001
    """Trained probabilities against counts over all segmentations, enumerated one by one."""
    names = ["▁", "▁a", "a", "b", "ab", "ba"]
    df = spark.createDataFrame([(1, "ab aba", "x"), (2, "ba ba b", "x"), (3, "bb", "y"), (None, "abc", "y")], "doc_id long, text string, lang string")
    got = langid.train(df, names, rounds=1)
    texts = {"x": Counter(["ab", "aba", "ba", "ba", "b"]), "y": Counter(["bb", "abc"])}

    def cuts(text: str):  # noqa: ANN202
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in names or n == 1:
                yield from ([text[:n], *rest] for rest in cuts(text[n:]))

    p = {lang: dict.fromkeys(names, 1 / len(names)) for lang in texts}
    for _ in range(2):
        new = {}
        for lang, words in texts.items():
            sums = Counter()
            for w, n in words.items():
                each = [(c, float(np.prod([p[lang].get(x, 1e-7) for x in c]))) for c in cuts("▁" + w)]
                for c, chance in each:
                    for x in c:
                        if x in names:
                            sums[x] += n * chance / sum(q for _, q in each)
            whole = sum(sums[x] + 0.01 for x in names)
            new[lang] = {x: (sums[x] + 0.01) / whole for x in names}
        p = new
    assert all(abs(got.prefixes[x][got.languages.index(lang)] - p[lang][x]) < 1e-9 for x in names for lang in p)


def test_language(spark, pieces, none) -> None:  # noqa: ANN001
    english, german = "the quick brown fox and the lazy dog with them", "der schnelle braune fuchs und der faule hund mit ihnen"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", None, 0) for i in range(40)] + [(50, None, None, None, 0), (51, "12 ¾ !", "en", None, 0), (52, "", None, None, 0), (53, german * 3000, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df, pieces)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0.5 < got[i][1] <= 1 for i in range(40))
    assert [got[i] for i in (50, 51, 52)] == [("und", 0.0)] * 3 and got[53][0] == "de"
    odd = langid.identify(df.withColumn("_made", F.lit("clash")).withColumn("score", F.lit("own")), model, ("l", "s")).first()
    assert odd._made == "clash" and odd.score == "own" and odd.l in ("en", "de")
    assert langid.train(none, pieces) is None and langid.identify(none, None).count() == 0


# op3


def test_matrix_and_shards(docs, none) -> None:  # noqa: ANN001
    matrix = np.array(communication_matrix([5, 0, 17, 3, 40], 7, 1))
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 3, 40] and set(matrix.sum(axis=0)) <= {9, 10}
    rng = np.random.Generator(np.random.PCG64(1))
    drawn = [hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]  # beyond numpy's bound
    assert abs(np.mean(drawn) - 750) < 4 and abs(np.std(drawn) - np.sqrt(1000 * 0.75 * 0.25)) < 3
    rows = shard_documents(docs).collect()
    n = len(make_docs())
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {d[0]: d[1] for d in make_docs()}
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in shard_documents(docs).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert shard_documents(none).count() == 0
    odd = docs.select("doc_id", F.lit(1).alias("slot"), F.lit("x").alias("other name"))
    assert shard_rows(odd, 3).columns == ["doc_id", "other name", "shard", "slot"]


def test_shuffle_is_uniform() -> None:
    """Chi-square tests of the matrix that deals the rows: shares of shards, and of pairs of rows of one part that meet."""
    draws, shards = 4_000, 3
    counts, together = np.zeros((4, shards)), 0
    for seed in range(draws):
        matrix = np.array(communication_matrix([2, 5, 3, 2], shards, seed))
        counts += matrix
        together += int((matrix[0] == 2).any())
    want = draws * np.array([2, 5, 3, 2])[:, None] / shards
    assert ((counts - want) ** 2 / want).sum() < 24  # the 0.998 quantile for 8 degrees, and drawn without replacement, so less
    chance = 3 * (4 / 12) * (3 / 11)  # both rows of the first part in one of three shards of four places
    assert abs(together - draws * chance) < 4 * (draws * chance * (1 - chance)) ** 0.5


def test_positions_inside_a_shard_are_uniform(spark) -> None:  # noqa: ANN001
    places = np.zeros((40, 2))
    df = spark.range(40).coalesce(1).cache()
    for seed in range(10):
        for r in shard_rows(df, 2, seed * 10).collect():
            places[r.id, 0] += r.slot < 10
            places[r.id, 1] += r.shard
    assert abs(places[:, 0].sum() - 200) <= 0 and places[:, 0].std() < 3 and 2.5 < places[:, 1].mean() < 7.5 and places[:, 1].max() <= 10


# op4


def brute_lines(rows: list[tuple], least: int) -> dict[int, tuple[int, int, str]]:
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out[r[0]] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


@pytest.mark.parametrize(("exact", "filters"), [(32_000_000, 64_000_000), (0, 64_000_000), (0, 20)])
def test_line_dedup(docs, none, exact: int, filters: int) -> None:  # noqa: ANN001
    """Keys sent to all tasks; lines that pass the filters joined with the keys; filters in several groups."""
    want = brute_lines(make_docs(), 10)
    odd = docs.withColumns({c: F.lit("clash") for c in ("n_lines", "_gone", "_id", "_hash")})
    index = LineIndex.of(odd, 10, shard_keys=1)
    assert index.shards == index.common.count() > 0
    for given in (None, index):
        got = drop_common_lines(odd, given, exact_bytes=exact, filter_bytes=filters).collect()
        assert len(got) == len(make_docs()) and any(r.n_dropped for r in got)
        assert all((r.n_lines, r.n_dropped, r.text) == want[r.doc_id] and {r._gone, r._id, r._hash} == {"clash"} for r in got)
    assert drop_common_lines(none, exact_bytes=exact, filter_bytes=filters).count() == 0


def test_filters_are_asked_at_every_size(docs) -> None:  # noqa: ANN001
    """Without its filters an index drops nothing, whichever way is taken."""
    index = LineIndex.of(docs, 10)
    blind = LineIndex(index.counts, index.filters.limit(0), 10, index.shards)
    for exact in (32_000_000, 0):
        assert drop_common_lines(docs, blind, exact_bytes=exact).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_index_is_reversible(docs) -> None:  # noqa: ANN001
    """Insertions and deletions undo each other, in the counts and in the filters."""

    def state(index: LineIndex) -> tuple:
        marks = set()
        for r in index.filters.collect():
            f = CuckooFilter.load(bytes(r.data))
            for at, slot in zip(*np.nonzero(f.marks)):
                mark = f.marks[at, slot]
                marks.add((r.shard, min(at, int(f._other(np.array([at]), np.array([mark]))[0])), mark, int((f.marks == mark).sum())))
        return sorted(tuple(r) for r in index.counts.collect()), marks

    part, rest = docs.filter("doc_id < 30"), docs.filter("doc_id >= 30")
    whole, first = LineIndex.of(docs, 3), LineIndex.of(part, 3)
    grown = first.insert(rest)
    assert state(grown)[0] == state(whole)[0] and state(grown.delete(rest)) == state(first) and state(whole.delete(rest))[0] == state(first)[0]
    assert {tuple(r) for r in grown.common.collect()} == {tuple(r) for r in whole.common.collect()}
    texts = lambda index: sorted((r.doc_id, r.text) for r in drop_common_lines(docs, index).collect())
    whole, first = LineIndex.of(docs, 40), LineIndex.of(part, 40)
    grown = first.insert(rest)
    assert texts(grown) == texts(whole) != texts(first) == texts(grown.delete(rest))
    with pytest.raises(ValueError, match="never inserted"):
        first.delete(rest)


def test_full_filters_are_built_again(spark) -> None:  # noqa: ANN001
    line = lambda n: spark.range(n).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    index = LineIndex.of(line(5), 1, shard_keys=5)
    grown = index.insert(line(400).filter("id >= 5"))  # beyond what its one filter of two buckets holds
    keys = line_keys([f"line {i}".encode() for i in range(400)])
    (row,) = grown.filters.collect()
    assert CuckooFilter.load(bytes(row.data)).contains(keys["h1"]).all()


def test_cuckoo_filters(spark) -> None:  # noqa: ANN001
    keys = np.random.default_rng(5).integers(0, 2**63, 4000).astype(np.uint64)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    others = keys ^ np.uint64(0x5555)
    assert f.contains(others).mean() < 0.01
    assert all(f.delete(k) for k in keys[:2000]) and f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.02
    lines = line_keys([f"line {i}".encode() for i in range(300)])
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(lines["h1"].view(np.int64), lines["h2"].view(np.int64))], "h1 long, h2 long")
    held = build_filters(frame, 4)
    after = update_filters(held, frame.limit(100), frame.limit(100), 4)
    loaded = {r.shard: CuckooFilter.load(bytes(r.data)) for r in after.collect() if r.data is not None}
    assert all(loaded[s].contains(lines["h1"][lines["h2"].view(np.int64) % 4 == s]).all() for s in loaded)


# op5


def test_encoder_gives_the_file_s_ids() -> None:
    fast, plain = encoder(public_file("byte_bpe_50k.json")), Encoder(public_file("byte_bpe_50k.json")).whole
    texts = [t[1] or "" for t in make_docs()] + ["a <|endoftext|> b", "naïve café — “quotes” 東京  \t\n\n x'll 123456 ☃☃", "́힣 ​ \xa0 ß", "aaaa" * 500, " " * 50]
    assert all(fast(t) == plain.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing_round_trip(spark, docs, none) -> None:  # noqa: ANN001
    path, size = public_file("byte_bpe_50k.json"), 64
    got = pack_documents(docs, path, size=size).collect()
    texts, n = {d[0]: d[1] for d in make_docs()}, Counter(d[0] for d in make_docs())
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, rows in per_doc.items():
        ids = np.array([*encoder(path)(texts[doc_id] or ""), 2], "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows})
        assert len(rows) == len(pieces) * n[doc_id] and [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == size for p in pieces[1:])
        assert all(zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) == p[3] for p in pieces)
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in got)
    assert len(per_sequence) <= -(-total // size) * 1.05 + 1
    assert pack_documents(none, path).count() == 0
    with pytest.raises(ValueError, match="no length"):
        pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long"))


def test_encoder_on_all_documents(spark) -> None:  # noqa: ANN001
    path = public_file("byte_bpe_50k.json")
    fast, plain = encoder(path), Encoder(path).whole
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert len(texts) >= 1000 and all(fast(t) == e.ids for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)))


def test_index_holds_every_sum() -> None:
    rng = np.random.default_rng(4)
    for _ in range(20):
        size, counts = 40, np.zeros(41, np.int64)
        counts[rng.choice(np.arange(1, 40), 9, replace=False)] = rng.integers(1, 4, 9)
        have = [x for x in range(41) if counts[x]]
        for gap in range(1, 40):
            found = SumIndex(counts.copy(), size).fill(gap, size - gap) if counts[size - gap] else None
            fits = lambda extra: not Counter((size - gap, *extra)) - Counter({x: int(counts[x]) for x in have})  # noqa: B023, E731
            ways = [e for n in (1, 2, 3) for e in combinations_with_replacement(have, n) if sum(e) == gap and fits(e)] if counts[size - gap] else []
            assert (found is None) == (not ways)
            if found:
                assert tuple(sorted(found[0])) in ways and len(found[0]) == min(map(len, ways)) and fits(found[0])


def test_plan_against_all_packings() -> None:
    """The least number of sequences, by search over all packings, for small inputs."""

    def least(lengths: tuple[int, ...], rooms: tuple[int, ...] = ()) -> int:
        if not lengths:
            return len(rooms)
        x, rest = lengths[0], lengths[1:]
        return min(least(rest, tuple(sorted((*rooms, 10 - x)))), *[least(rest, tuple(sorted((*rooms[:i], r - x, *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= x and r not in rooms[:i]], 99)

    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = tuple(sorted(rng.integers(1, 11, 7).tolist(), reverse=True))
        used = sum(n for _, n in packing_plan(np.bincount(lengths, minlength=11), 10))
        assert least(lengths) <= used <= least(lengths) + 1


def test_plan_uses_every_piece() -> None:
    rng = np.random.default_rng(2)
    for kind in range(4):
        counts = np.zeros(101, np.int64)
        counts[[np.arange(1, 101), np.arange(60, 101), np.array([35, 70]), np.array([1])][kind]] = rng.integers(0, 400)
        used = Counter()
        for lengths, n in packing_plan(counts, 100):
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] += n
        assert all(used[x] == counts[x] for x in range(101))


# op6


def test_fingerprints(docs, none, spark) -> None:  # noqa: ANN001
    rows = sorted(make_docs(), key=lambda r: (-r[0], r[1] or ""))
    got = defaultdict(list)
    for r in fingerprint_edits(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, row in enumerate(rows):
        text, following = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        edited = edited_text(text, following)
        assert any((r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canonical(text)), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(following))) for r in got[row[0]])
    plain = {r.doc_id: r.fingerprint for r in fingerprint(docs).collect()}
    assert plain == {k: v[0].fingerprint for k, v in got.items()}
    folded = spark.createDataFrame([(1, "Ｆｕｌｌ  Wıdth ﬁ"), (2, " full wıdth FI\n"), (3, "Full"), (None, None), (4, "")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprint(folded).collect()}
    assert f[1] == f[2] != f[3] and f[None] == f[4]
    assert fingerprint_edits(none).count() == 0 and fingerprint(none).count() == 0
    one = fingerprint_edits(folded.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("shared", [64_000_000, 0])
def test_colliding_digests_are_told_apart(spark, shared: int) -> None:  # noqa: ANN001
    """Digests cut to one hexadecimal digit: many forms share each, and equal fingerprints still mean equal forms."""
    rows = [(i, f"Text {i // 2}" if i % 2 else f"text  {i // 2} ") for i in range(80)] + [(None, "text 3"), (None, None), (7, "another of the same id"), (7, "Text 3"), (90, ""), (91, "ab"), (92, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    form = {i: canonical(t) for i, t in enumerate([r[1] for r in rows])}
    plain = fingerprint(df, digits=1, shared_bytes=shared).collect()
    assert len(plain) == len(rows) and len({r.fingerprint for r in plain}) == len(set(form.values()))
    got = fingerprint_edits(df, digits=1, shared_bytes=shared).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] is not None, r[1] or "")))
    want = Counter()
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edited = edited_text(text, following)
        want[doc_id, hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(following))] += 1
    assert Counter((r.doc_id, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    meant: dict[str, set] = defaultdict(set)  # what each fingerprint stands for, own or edited
    for i, (doc_id, text) in enumerate(order):
        edited = edited_text(text, order[(i + 1) % len(order)][1])
        sha = hashlib.sha256(edited.encode()).hexdigest()
        for r in got:
            if (r.doc_id, r.edited_sha256, r.n_chars) == (doc_id, sha, len(text or "")):
                meant[r.edited_fingerprint].add(canonical(edited))
                meant[r.fingerprint].add(canonical(text))
    assert all(len(x) <= 1 for x in meant.values())


def test_order_needs_whole_numbers(spark) -> None:  # noqa: ANN001
    with pytest.raises(TypeError, match="whole number"):
        fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# op7


def brute_components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    sets: dict[int, set] = {}
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r[1] or "").encode()))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and label[a] != label[b] and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def near_rows() -> list[tuple]:
    rng = np.random.default_rng(9)
    rows = make_docs(20)
    base = rng.choice([f"w{i}" for i in range(400)], 120).tolist()
    for i in range(60):  # copies with a few words changed: linked to the base more often than to each other
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
            words[at] = f"x{i}{at}"
        rows.append((1000 + i, " ".join(words), "en", "s0", 0))
    return rows


def test_near_duplicates(spark, none) -> None:  # noqa: ANN001
    rows = near_rows()
    df = spark.createDataFrame(rows, DOCS)
    want = brute_components(rows)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in got)
    kept = keep_one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()})
    assert near_duplicates(none).count() == 0 and keep_one_of_each(none).count() == 0


def test_near_duplicates_without_broadcasts(spark, monkeypatch) -> None:  # noqa: ANN001
    """Texts of pairs met by a join; odd rows and clashing columns in keep_one_of_each."""
    import termloom.llm.neardup as module

    rows = near_rows()
    want = brute_components(rows)
    monkeypatch.setattr(module, "EVERYWHERE", 0)
    df = spark.createDataFrame(rows, DOCS)
    assert all(r.component_id == want[r.doc_id][1] for r in near_duplicates(df).collect())
    odd = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "A B C D E F", 1), (None, "x y", 2), (None, None, 3), (5, None, 4), (6, "", 5)], "doc_id long, text string, _text int")
    odd = odd.withColumns({c: F.lit("own") for c in ("_hash", "row", "_key")})
    got = keep_one_of_each(odd).collect()
    assert Counter((r.doc_id, r.text, r._text) for r in got) == Counter([(1, "a b c d e f", 1), (None, "x y", 2), (None, None, 3), (5, None, 4), (6, "", 5)])
    assert all((r._hash, r.row, r._key) == ("own", "own", "own") for r in got)


def test_recall_near_the_threshold(spark) -> None:  # noqa: ANN001
    """Pairs with known similarities of 0.75 to 0.8, each alone: all links are found, and none below."""
    rng = np.random.default_rng(12)
    rows, linked = [], {}
    for i in range(150):
        n = int(rng.integers(60, 400))
        words = [f"p{i}w{j}" for j in range(n + 4)]
        keep = int(np.ceil((0.74 if i % 3 == 0 else rng.uniform(0.75, 0.8)) * n))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: keep + 4]))]
        linked[2 * i + 1] = 100 * keep >= 75 * n
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[d] == d - 1) == is_linked for d, is_linked in linked.items()) and sum(linked.values()) >= 90


def test_samples_keep_every_link() -> None:
    """Pairs around the threshold, of whole samples, cut ones and one of each; and nothing far below is kept."""
    rng = np.random.default_rng(6)
    for n in (8, 300, SAMPLE - 100, SAMPLE + 50, 6 * SAMPLE):
        for same in rng.integers(int(0.75 * n), int(0.95 * n), 40):
            pool = rng.integers(0, 2**64, 2 * n, np.uint64)
            x, y = np.unique(pool[:n]), np.unique(pool[n - same : n - same + int(n * rng.uniform(0.85, 1.1))])
            both, u = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            cut = [(s[:SAMPLE] >> np.uint64(32)).astype(np.uint32) for s in (x, y)]
            found = may_link(*cut, len(x), len(y), 75)
            assert found == may_link(*cut[::-1], len(y), len(x), 75)
            assert found or 100 * both < 75 * u
            assert not found or both >= (0.74 if max(len(x), len(y)) <= SAMPLE else 0.62) * u


def test_near_duplicates_in_last_step(spark, monkeypatch) -> None:  # noqa: ANN001
    """Rows whose groups leave pairs to the last step, in blocks of three members."""
    import termloom.llm.neardup as module

    rows = near_rows()
    want = brute_components(rows)
    monkeypatch.setattr(module, "BLOCK", 3)
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.component_id == want[r.doc_id][1] for r in got)


def test_registers_merge_and_estimate() -> None:
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 2000, np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[300:2000])
    ra, rb, rc = registers([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(ra, rb) == rc).all() and len(ra) == M
    found = estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(found - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


# op8


def test_quality(spark, none) -> None:  # noqa: ANN001
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        words = rng.choice(WORDS, 30).tolist()
        rows.append((i, " ".join(w + "***$$" for w in words) if i % 4 == 0 else " ".join(words), int(i % 4 != 0)))
    rows += [(900, None, 1), (901, "", None), (902, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.train(df, trees=5)
    scored = quality.score_quality(df, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.quality_score <= 1 for r in scored)
    assert min(r.quality_score for r in scored if r.doc_id < 300 and r.label) > max(r.quality_score for r in scored if r.doc_id < 300 and not r.label)
    x = np.array([quality.statistics(r.text) for r in scored])
    for row, r in zip(x, scored):  # one row at a time, by hand
        margin = model.base
        for feature, limit, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            margin += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-margin)) - r.quality_score) < 1e-9
    empty = quality.train(none.select("doc_id", "text", F.lit(1).alias("label")))
    assert quality.score_quality(none, empty).count() == 0 and len(empty.leaf) == 0


# op9


def test_top_k(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(200)]  # many ties
    vectors += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    ints = integer_vectors(df)
    got = defaultdict(list)
    for r in top_k(ints.filter("vec_id % 20 = 0"), ints, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in vectors[:200]}
    for q in range(0, 200, 20):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
        assert sorted(got[q]) == [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    few = integer_vectors(df.filter("vec_id < 5"))
    assert top_k(few.filter("vec_id = 0"), few, 20).count() == 4
    assert top_k(few.limit(0), few, 20).count() == 0


def test_top_k_on_a_grid(spark, monkeypatch) -> None:  # noqa: ANN001
    """Several rows and columns of small blocks give what one cell gives; a grid moves few copies and keeps to its bytes."""
    for q, c, width, tasks in ((1, 1, 64, 24), (6, 13, 64, 18), (9_766, 24_415, 64, 3_000), (5, 5, 100_000, 4), (40, 2, 8, 60)):
        rows, columns = topk.grid(q, c, width, tasks)
        assert 1 <= rows <= q and 1 <= columns <= c and rows * columns >= min(tasks, q * c)
        assert rows == q or -(-q // rows) * topk.QUERIES * 8 * width <= topk.CELL_QUERIES
        assert columns == c or -(-c // columns) * topk.BLOCK * 8 * width <= topk.CELL_CANDIDATES
    assert topk.grid(9_766, 24_415, 64, 3_000) == (41, 201)  # 1e8 vectors: a query moves 201 times, not 24,415 times
    rng = np.random.default_rng(21)
    v = rng.integers(-1, 2, (300, 5))
    ints = spark.createDataFrame([(i, x.astype(float).tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    got = defaultdict(list)
    for r in top_k(ints.filter("vec_id % 20 = 0"), ints, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 20):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(300) if c != q)[:20]
        assert sorted(got[q]) == [(i + 1, c, -s) for i, (s, c) in enumerate(best)]


def test_top_k_of_odd_vectors(spark) -> None:  # noqa: ANN001
    """Unequal and empty vectors, scores beyond doubles' whole numbers and beyond a long, an empty table's neighbours."""

    def brute(vectors: dict[int, list[float]], q: int) -> list[tuple]:
        whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in vectors.items()}
        end = 2**63 - 1
        score = lambda c: max(-end, min(end, sum(x * y for x, y in zip(whole[q], whole[c]))))
        return [(i + 1, c, -s) for i, (s, c) in enumerate(sorted((-score(c), c) for c in vectors if c != q)[:20])]

    rng = np.random.default_rng(3)
    small = {i: rng.normal(size=int(rng.integers(0, 6))).tolist() for i in range(40)}
    large = {i: (rng.normal(size=4) * 10.0 ** int(rng.integers(0, 9))).tolist() for i in range(60)}
    huge = large | {100: [1e9, -1e9, 3.0, 0.0], 101: [1e300] * 4, 102: [-1e300, 1.0, 1.0, 1.0], 120: [1e18, 1e18], 140: [1.7e38]}
    for vectors in (small, large, huge, {0: [], 20: [], 3: []}, {0: [1e9], 1: [1e9]}):
        ints = integer_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
        got = defaultdict(list)
        for r in top_k(ints.filter("vec_id % 20 = 0"), ints, 20).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        for q in vectors:
            if q % 20 == 0:
                assert sorted(got[q]) == brute(vectors, q), q
    a = rng.integers(-(2**31), 2**31, (5, 3)).astype(float)
    assert (exact_products(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()


# op10


def test_schedule(spark) -> None:  # noqa: ANN001
    """Every block has one slot, blocks follow the slots, and any first part of the schedule keeps the weights."""
    blocks = [5, 0, 700, 250, 1, 64]
    frame = spark.createDataFrame(list(enumerate(blocks)), "source_no long, blocks long")
    schedule, span = source_schedule(frame, 7)
    slots = sorted((r.slot, r.source_no, r.block) for r in schedule.collect())
    assert len(slots) == sum(blocks) and slots[-1][0] < span == 1024
    assert Counter((n, b) for _, n, b in slots) == Counter((n, b) for n, size in enumerate(blocks) for b in range(size))
    seen: Counter = Counter()
    for i, (slot, source, block) in enumerate(slots):
        assert block == seen[source]  # ranked in order
        seen[source] += 1
        assert all(abs(seen[n] - (i + 1) * size / sum(blocks)) <= 6 for n, size in enumerate(blocks))
    bits = span.bit_length() - 1
    assert [s for s, _, _ in slots] == [j for j in range(span) if int(f"{j:0{bits}b}"[::-1], 2) < sum(blocks)]


def test_the_schedule_decides(docs) -> None:  # noqa: ANN001
    """Half of the schedule takes half of the words of each source; another schedule takes other words."""
    whole, half = (mix_sources(docs, block=4, part=p) for p in (1.0, 0.5))
    taken = lambda mix: {r.source: r.n for r in mix.documents.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    a, b = taken(whole), taken(half)
    assert all(abs(b[s] - a[s] / 2) <= 4 * 6 for s in a) and sum(b.values()) < 0.6 * sum(a.values())
    slots = {r.row_id: r.first_slot for r in half.documents.filter("taken > 0").collect()}
    low = {r.row_id: r.s for r in half.segments.groupBy("row_id").agg(F.min("slot").alias("s")).collect()}
    assert slots == low and all(s < whole.span / 2 for s in slots.values())


def test_mixing_with_many_sources_and_clashes(spark, monkeypatch) -> None:  # noqa: ANN001
    import termloom.llm.mixing as module

    rows = [(i, "w " * (i % 9), f"s{i % 40}" if i % 11 else None, "own", "own") for i in range(300)] + [(None, "a b", "s1", "own", "own"), (None, None, None, "own", "own"), (3, "w w w ", "s3", "own", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, row_id string")
    few = sorted(map(str, mix_sources(df, block=4).documents.select("doc_id", "size", "target", "taken").collect()))
    monkeypatch.setattr(module, "MANY_SOURCES", 0)
    assert sorted(map(str, mix_sources(df, block=4).documents.select("doc_id", "size", "target", "taken").collect())) == few
    out = mixed_documents(df).collect()
    assert all((r._id, r.row_id) == ("own", "own") for r in out) and len([r for r in out if not (r.text or "").split()]) == len([r for r in rows if not (r[1] or "").split()])


def test_mixed_rows_follow_the_slots(docs) -> None:  # noqa: ANN001
    """Read in order, the rows' sources keep the weights from the start."""
    out = mixed_documents(docs.filter("length(text) > 5"))
    first = [r for r in out.collect() if r.text.split()]
    again = [r for r in mixed_documents(docs.filter("length(text) > 5")).collect() if r.text.split()]
    assert first == again
    place = {}
    for i, r in enumerate(first):
        place.setdefault(r.source, []).append(i / len(first))
    assert all(0.2 < np.mean(x) < 0.8 for x in place.values() if len(x) > 5)


def test_mixing(docs, none, spark) -> None:  # noqa: ANN001
    mix = mix_sources(docs, block=8)
    rows = mix.documents.collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", {d[0]: d[1] for d in make_docs()}[r.doc_id] or ""))
        assert r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # share out, cap, share the excess again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            want |= {s: weights[s] * level for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(want[s] for s in over)
        open_ -= over
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in order)
    held = {(r.source_no, r.block): r.n for r in mix.segments.groupBy("source_no", "block").agg(F.sum("n_words").alias("n")).collect()}
    slots = mix.schedule.collect()
    assert len(slots) == len({(r.source_no, r.block) for r in slots}) == len(held) and all(n <= 8 for n in held.values())
    assert {(r.row_id, r.taken) for r in mix_sources(docs, block=8).documents.collect()} == {(r.row_id, r.taken) for r in rows}
    assert mix_sources(none).documents.count() == 0 and mixed_documents(none).count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns and max(Counter(r.doc_id for r in out.filter("doc_id > 0").collect()).values()) <= 2


def test_columns_named_as_working_ones(spark) -> None:  # noqa: ANN001
    """Every name that running sums, packing and sharding work with is kept where a table has it."""
    names = ["_size", "_total", "_before", "_local", "_s_id", "_s_part", "_s_ends", "_s_rank", "_s_key", "_s_bucket", "_p_row", "_p_bucket", "_p_rank"]
    rows = spark.range(200).select("id", (F.col("id") % 9 + 1).alias("length"), *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names])
    for out in (shard_rows(rows, 5), pack(rows, 16)):
        found = out.collect()
        assert len(found) == 200 and all(r[n] == f"{n}{r.id}" for r in found for n in names)


def test_labels_that_are_no_numbers(spark) -> None:  # noqa: ANN001
    nan = float("nan")
    rows = [(i, f"text {i} " * (3 if i % 2 else 30), float(i % 2)) for i in range(60)]
    model = quality.train(spark.createDataFrame([*rows, (100, "x", nan), (101, "y", None)], "doc_id long, text string, label double"))
    same = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label double"))
    assert math.isfinite(model.base) and math.isclose(model.base, same.base) and np.allclose(model.leaf, same.leaf)


def test_another_schedule_changes_the_mix(spark, monkeypatch) -> None:  # noqa: ANN001
    """Slots of the registered result come from the schedule: turned round, it gives the same amounts in other places."""
    from termloom.llm import queries as Q

    data = "/root/testdata/sf0.001"
    plain = {r.doc_id: r for r in Q.op10_mixing(spark, data).collect()}
    schedule = mixing.source_schedule

    def turned(sources, buckets, part=1.0):  # noqa: ANN001, ANN202
        made, span = schedule(sources, buckets, part)
        return made.withColumn("slot", F.lit(span - 1) - F.col("slot")), span

    monkeypatch.setattr(mixing, "source_schedule", turned)
    other = {r.doc_id: r for r in Q.op10_mixing(spark, data).collect()}
    assert all(plain[i].taken == other[i].taken for i in plain)
    assert sum(plain[i].slots != other[i].slots for i in plain if plain[i].taken) > 0.9 * sum(r.taken > 0 for r in plain.values())
    for r in plain.values():
        assert (r.first_slot is None) == (r.taken == 0) and (r.taken == 0 or (r.slots[0] == r.first_slot and r.slots == sorted(set(r.slots))))
    slots = [s for r in plain.values() for s in r.slots or []]
    assert max(slots) >= 0.9 * len(set(slots))  # the schedule's places, spread over the whole mix


def test_near_dedup_margin_is_wide() -> None:
    from termloom.llm import neardup as N

    error = (0.75 * 0.25 / N.M) ** 0.5  # of an estimate at the threshold
    assert N.MARGIN > 5 * error


def test_filters_never_pass_the_driver_beyond_their_limit(spark, monkeypatch) -> None:  # noqa: ANN001
    """Many small filters, a line that a third of all documents share, and nothing collected: the result of the small way."""
    from termloom.llm import linededup

    rows = [(i, "\n".join([f"line {i % 40}", f"own {i}", "everywhere" if i % 3 == 0 else f"rare {i // 15}", ""])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("shard", "salt", "data")})
    index = LineIndex.of(docs, 10, shard_keys=4)
    assert index.shards > 5
    small = {tuple(r) for r in drop_common_lines(docs, index).collect()}

    def refuse(*_: object) -> None:
        raise AssertionError("filters on the driver")

    monkeypatch.setattr(linededup, "_collected", refuse)
    assert {tuple(r) for r in drop_common_lines(docs, index, exact_bytes=0, filter_bytes=0).collect()} == small
    assert sum(r[-1] for r in small) >= 600
