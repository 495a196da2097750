"""Tables whose keys are larger than those of the driver's smallest ones."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from termloom.operators import hierarchy as H
from termloom.operators import search as S
from termloom.operators import valuesets as VS
from termloom.plans import ORACLES, QUERIES
from termloom.sources import written as W
from tests.test_queries import DATA, shown


def shifted(folder: Path, changed: dict[str, str]) -> str:
    """The driver's smallest tables, some with other columns (DuckDB REPLACE lists)."""
    con = duckdb.connect()
    for name in os.listdir(DATA):
        replaced = changed.get(name.split(".")[0])
        if replaced:
            con.execute(f"COPY (SELECT * REPLACE ({replaced}) FROM '{DATA}/{name}') TO '{folder}/{name}' (FORMAT parquet)")
        else:
            (folder / name).symlink_to(f"{DATA}/{name}")
    return str(folder)


def same(spark, name: str, folder: str) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    got, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows and rows == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["read_icd10cm_order"])
def test_part_keys_of_seven_digits(spark, tmp_path, name: str) -> None:  # noqa: ANN001
    same(spark, name, shifted(tmp_path, {"part": "p_partkey + 7199900 AS p_partkey"}))


def test_order_keys_of_seven_digits(spark, tmp_path) -> None:  # noqa: ANN001
    same(spark, "snapshot_from_full", shifted(tmp_path, {"orders": "o_orderkey + 8999000 AS o_orderkey"}))


def test_equal_queries_are_ranked_once(spark) -> None:  # noqa: ANN001
    """Hits are of distinct lists of words, however many queries have them."""
    names = spark.range(60).selectExpr("concat('d', id) AS designation_id", "concat('c', id) AS code", "concat(CASE WHEN id % 2 = 0 THEN 'large' ELSE 'small' END, ' ring ', id % 7) AS term")
    queries = spark.range(90).selectExpr("id AS query_id", "CASE WHEN id % 3 = 0 THEN 'R lar' WHEN id % 3 = 1 THEN 'LAR r' ELSE 'sm' END AS text")
    index = S.ranked_index(names)
    assert S._found(S._asked(queries), index, "rank").groupBy("_words").count().select("count").collect() == [(30,), (30,)]
    want = sorted(map(tuple, S.rank_page(S.prefix_search(queries, S.inverted_index(names)), names, 2, 5).collect()))
    assert len(want) == 450 and sorted(map(tuple, S.search_page(queries, S.inverted_index(names), names, 2, 5).collect())) == want
    for short in (None, S.short_pages(index, 2, 9)):
        assert sorted(map(tuple, S.first_page(queries, index, names, 2, 5, short, 2, 9).collect())) == want


def test_buckets_grow_with_rows() -> None:
    """A task reads one bucket of all versions, so that its rows stay about the same."""
    assert [W.buckets_for(n) for n in (0, 400_000, 400_001, 59_000_000)] == [8, 8, 9, 1180]


def test_leaves_move_a_parent_once(spark) -> None:  # noqa: ANN001
    """Parents are made distinct before they are met, so that the children of one parent do not fill a task."""
    edges = spark.range(50).selectExpr("concat('c', id) AS child", "'top' AS parent")
    found = H.leaves(edges.select(F.col("child").alias("code")).unionByName(edges.select(F.col("parent").alias("code")).distinct()), edges)
    assert found.count() == 50 and "Deduplicate" in found._jdf.queryExecution().logical().toString()


def test_long_lists_do_not_pass_the_driver(spark, monkeypatch) -> None:  # noqa: ANN001
    """Beyond BROADCAST_ROWS listed codes and excluded ones are joined by shuffle, with the same result."""
    rules = spark.createDataFrame([r for side, codes in (("include", "abcd"), ("exclude", "d")) for r in VS.rule("u", side, 0, "s", codes=list(codes.upper()))], VS.RULES)
    concepts = spark.createDataFrame([("s", c, c, True, False, "m") for c in "abdef"], "system string, code string, display string, active boolean, abstract boolean, module string")
    none = spark.createDataFrame([], "system string, code string, property string, value_text string")
    edges = spark.createDataFrame([], "system string, child string, parent string")
    systems = spark.createDataFrame([("s", "1", False)], "system string, version string, case_sensitive boolean")
    t = VS.SystemTables(concepts, edges, lambda: None, none, systems)
    for rows, hinted in ((100, False), (2, True)):
        monkeypatch.setattr(VS, "BROADCAST_ROWS", rows)
        out = VS.expand(rules, t)
        assert sorted(r["code"] for r in out.collect()) == ["a", "b"]
        assert ("strategy=merge" in VS.enumerated(VS._counted(rules), t)._jdf.queryExecution().analyzed().toString()) is hinted
