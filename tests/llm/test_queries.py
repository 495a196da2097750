"""The registered corpus queries: their SQL where there is one, held-out accuracy, and the pipeline against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from termloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def test_registered() -> None:
    names = set(entry.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name: str) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = Q.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({Q.ORACLES[name]})").fetchall())


def test_held_out_accuracy(spark) -> None:  # noqa: ANN001
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = Q.op2_language_id(spark, DATA).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    large = DATA.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    scored = [r for r in Q.op8_quality(spark, large).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([r for r in scored if labels[r.doc_id] == x] for x in (1, 0))
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in good for b in bad]
    assert len(bad) >= 5 and sum(pairs) / len(pairs) >= 0.9  # area under the curve: a constant score has 0.5
    assert sum(r.predicted == 0 for r in bad) >= 0.5 * len(bad) and sum(r.predicted for r in good) >= 0.95 * len(good)


def test_pipeline(spark) -> None:  # noqa: ANN001
    """Stage by stage against brute force on what the stage before has kept."""
    from tests.llm.test_operators import brute_components, brute_lines

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.filter("text rlike '\\\\p{L}'").count()
    clean = corpus_pipeline.line_dedup(spark, kept, DATA).cache()
    want = brute_lines([tuple(r) for r in kept.collect()], Q.MIN_LINE_DOCS)
    assert clean.columns == docs.columns and all((r.text, r.n_chars) == (want[r.doc_id][2], len(want[r.doc_id][2])) for r in clean.collect())
    single = corpus_pipeline.near_dedup(spark, clean, DATA).cache()
    groups = brute_components([tuple(r) for r in clean.collect()])
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    mixed = corpus_pipeline.mixing(spark, single, DATA).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= {r.doc_id for r in single.collect()} and max(times.values()) <= 2
    packed = corpus_pipeline.packing(spark, mixed, DATA).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    # the mix as a whole: the words of each source near its target, and rows as often as their slots say
    from termloom.llm.mixing import mix_sources

    target = {r.source: r.target for r in mix_sources(single).documents.collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    longest = max(len((r.text or "").split()) for r in single.collect())
    assert all(abs(words[x] - t) <= longest for x, t in target.items())


def test_pipeline_of_odd_tables(spark, tmp_path) -> None:  # noqa: ANN001
    """Clashing columns, texts of null alone, and no rows at all: every stage keeps the columns, and the run ends."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    names = ["score", "lang_pred", "_lang", "_made", "n_lines", "n_dropped", "_gone", "_id", "_text", "_hash", "row", "row_id", "_copy", "slot"]
    odd = docs.withColumns({c: F.lit(c) for c in names})
    bare = spark.createDataFrame([(1, None, None, None, None), (None, None, "en", "a", 1), (2, None, "en", "a", 1)], docs.schema)
    for i, table in enumerate((odd, bare, docs.limit(0))):
        folder = str(tmp_path / f"{i}")
        table.write.parquet(f"{folder}/documents.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, folder)
            assert kept.columns == table.columns
        if i == 0:
            assert kept.count() and all(r[c] == c for r in kept.collect() for c in names)
        assert corpus_pipeline.run(spark, folder).count() >= (i == 0)
