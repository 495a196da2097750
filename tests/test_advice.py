"""What the first round's advice found missing."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from termloom.operators import codes as K
from termloom.operators import hierarchy as H
from termloom.plans import QUERIES
from termloom.plans.driver_views import Views
from termloom.sources import terminologies as T

DATA = "/root/testdata/sf0.001"


def test_stream_rollup_over_several_batches(spark, tmp_path) -> None:  # noqa: ANN001
    for name in os.listdir(DATA):
        if name != "events.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")  # a file a partition, so more files than one batch takes
    try:
        got = QUERIES["stream_rollup"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert any("/batch=1/" in f for f in got.inputFiles())  # counts are read from several batches' files, not from the driver
    coded = events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), F.concat(F.lit("C:"), (F.col("event_id") % 2000).cast("string")).alias("code"))
    up = Views(spark, DATA).closure.select(F.col("descendant").alias("code"), "ancestor")
    want = coded.join(up, "code").select("start", F.col("ancestor").alias("code")).unionByName(coded).groupBy("start", "code").count()
    assert sorted(map(tuple, got.select("start", "code", "n").collect())) == sorted(map(tuple, want.collect()))


_ELEMENTS = "map string, group_no int, source string, target string, code string, target_code string, relationship string, no_map boolean"
_RULES = "map string, group_no int, mode string, fixed_code string, relationship string, other_map string"


def test_each_group_has_its_own_unmapped_rule(spark) -> None:  # noqa: ANN001
    elements = spark.createDataFrame([("m", 0, "s", "x", "a", "xa", "equal", False), ("m", 1, "s", "y", "b", "yb", "wider", False), ("m", 2, "other", "z", "c", "zc", "equal", False)], _ELEMENTS)
    rules = spark.createDataFrame([("m", 0, "fixed", "x0", None, None), ("m", 1, "provided", None, None, None), ("m", 2, "fixed", "z0", "equivalent", None)], _RULES)
    facts = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "system string, code string")
    got = {(r.code, r.target, r.target_code, r.relationship) for r in K.translate_unmapped(facts, elements, rules, "m").collect()}
    assert got == {
        ("a", "x", "xa", "equivalent"), ("a", "y", "a", "equivalent"), ("b", "x", "x0", "related-to"),
        ("b", "y", "yb", "source-is-narrower-than-target"), ("c", "x", "x0", "related-to"), ("c", "y", "c", "equivalent"),
    }


def test_chain_follows_each_group_and_refuses_a_circle(spark) -> None:  # noqa: ANN001
    elements = spark.createDataFrame([("m", 0, "s", "x", "a", "xa", "equal", False), ("n", 0, "s", "y", "b", "yb", "equal", False), ("o", 0, "s", "z", "b", "zb", "equal", False)], _ELEMENTS)
    facts = spark.createDataFrame([("a",), ("b",)], "code string")
    both = spark.createDataFrame([("m", 0, "other-map", None, None, "n"), ("m", 1, "other-map", None, None, "o")], _RULES)
    got = sorted((r.code, r.target_code, r.applied) for r in K.translate_chain(facts, elements, both, "m").collect())
    assert got == [("a", "xa", ["m"]), ("b", "yb", ["m", "n"]), ("b", "zb", ["m", "o"])]
    circle = spark.createDataFrame([("m", 0, "other-map", None, None, "n"), ("n", 0, "other-map", None, None, "m")], _RULES)
    with pytest.raises(ValueError, match="more than 2 times"):
        K.translate_chain(facts.union(spark.createDataFrame([("c",)], "code string")), elements, circle, "m", depth=2)
    with pytest.raises(ValueError, match="does not exist"):
        K.translate_chain(facts, elements, spark.createDataFrame([("m", 0, "other-map", None, None, "gone")], _RULES), "m")


def test_deep_code_system_is_read_whole(spark, tmp_path) -> None:  # noqa: ANN001
    tree = {"code": "c12", "designation": [{"language": "en", "value": "leaf"}], "property": [{"code": "parent", "valueCode": "gone"}]}
    for i in range(11, -1, -1):
        tree = {"code": f"c{i}", "property": [{"code": "level", "valueInteger": i}], "concept": [tree]}
    extra = {"url": "v", "content": "supplement", "concept": [{"code": "x", "property": [{"code": "parent", "valueCode": "base"}]}]}
    (tmp_path / "cs.json").write_text(json.dumps({"url": "u", "version": "1", "concept": [tree, {"code": "c3"}]}) + "\n" + json.dumps(extra))
    for depth in (0, 2):
        got = T.read_fhir_code_system(spark, str(tmp_path / "cs.json"), depth)
        assert {(r.child, r.parent) for r in got["edges"].filter("url = 'u'").collect()} == {(f"c{i + 1}", f"c{i}") for i in range(12)} | {("c12", "gone")}
        assert got["concepts"].count() == 15 and got["properties"].count() == 14 and got["designations"].first().term == "leaf"
        assert {(r.url, r.code, r.parent, r.reason) for r in got["problems"].collect()} == {("u", "c3", None, "duplicate-code"), ("u", "c12", "gone", "unknown-parent")}


def test_preorder_page_has_deep_and_circular_members(spark) -> None:  # noqa: ANN001
    deep = [(f"n{i + 1:02}", f"n{i:02}") for i in range(66)]
    edges = spark.createDataFrame([*deep, ("n00", "n02x"), ("b", "a"), ("a", "b"), ("q", "p"), ("r", "q"), ("q", "r")], "child string, parent string")
    codes = spark.createDataFrame([(c,) for c in [f"n{i:02}" for i in range(67)] + ["a", "b", "p", "q", "r"]], "code string")
    rows = [tuple(r) for r in H.preorder_page(codes, edges, 0, 100).orderBy("place").collect()]
    want = [(f"n{i:02}", i) for i in range(67)] + [("p", 0), ("q", 1), ("r", 2), ("a", 0), ("b", 0)]
    assert rows == [(i, code, depth, 72) for i, (code, depth) in enumerate(want)]


def test_refset_filter_takes_all_sets(spark, tmp_path) -> None:  # noqa: ANN001
    for name in os.listdir(DATA):
        if name != "customer.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    customers = spark.read.parquet(f"{DATA}/customer.parquet").withColumn("c_mktsegment", F.concat(F.lit("S"), F.col("c_custkey").cast("string")))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    want = {f"SEG:S{r[0]}" for r in customers.filter("c_acctbal >= 0").select("c_custkey").collect()}
    assert len(want) > 100 and {r.url for r in QUERIES["vs_filter_refset"](spark, str(tmp_path)).collect()} == want


def test_edition_and_closure_stream_use_more_than_one_task(spark, monkeypatch) -> None:  # noqa: ANN001
    plan = QUERIES["identify_edition"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan

    def refuse(*_: object) -> None:
        raise AssertionError("all rows in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refuse)
    files = QUERIES["stream_closure_delta"](spark, DATA).inputFiles()
    assert {f.split("version=")[1][0] for f in files} == {"0", "1", "2"}  # still a batch a module


