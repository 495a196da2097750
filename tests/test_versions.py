"""Several versions side by side: facts keep one row, rules their version, and written tables each other's."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from termloom.operators import codes as K
from termloom.operators import releases as R
from termloom.operators import valuesets as VS
from termloom.operators import versioned as VV
from termloom.sources import written as W

SYSTEMS = [("s", "1", True, "complete"), ("s", "2", True, "complete"), ("s", "10", True, "complete"), ("t", "1", False, "complete")]


@pytest.fixture(scope="module")
def small_world(spark):  # noqa: ANN001, ANN201
    systems = spark.createDataFrame(SYSTEMS, "system string, version string, case_sensitive boolean, content string")
    rows = [("s", v, c, c.upper(), a) for v, c, a in (("1", "a", True), ("2", "a", True), ("10", "a", False), ("1", "b", True), ("10", "b", True), ("2", "c", True))] + [("t", "1", "X", "x", True), ("t", "1", "x", "x", True)]
    contents = spark.createDataFrame(rows, "system string, version string, code string, display string, active boolean").withColumn("abstract", F.lit(False)).withColumn("module", F.lit("m"))
    return systems, contents, VV.number_releases(systems)


def test_intervals(small_world) -> None:  # noqa: ANN001
    systems, contents, releases = small_world
    assert {(r.system, r.version): r.release_no for r in releases.collect()} == {("s", "1"): 1, ("s", "2"): 2, ("s", "10"): 3, ("t", "1"): 1}
    got = sorted((r.system, r.key, r.code, r.active, r.from_no, r.to_no) for r in VV.code_intervals(contents, releases).collect())
    assert got == [("s", "a", "a", False, 3, 3), ("s", "a", "a", True, 1, 2), ("s", "b", "b", True, 1, 1), ("s", "b", "b", True, 3, 3), ("s", "c", "c", True, 2, 2), ("t", "x", "X", True, 1, 1)]


def test_facts_keep_one_row(spark, small_world) -> None:  # noqa: ANN001
    systems, contents, releases = small_world
    facts = spark.createDataFrame([(1, "s", "a"), (2, "s", "c"), (3, "t", "x"), (4, "u", "a"), (5, None, "a")], "id int, system string, code string")
    one = contents.select("system", "code", "display", "active", "abstract").groupBy("system", "code").agg(F.min("display").alias("display"), F.max("active").alias("active"), F.max("abstract").alias("abstract"))
    none = spark.createDataFrame([], "system string, code string, language string, use_code string, term string, active boolean")
    props = spark.createDataFrame([], "system string, code string, property string, value_text string")
    expansion = one.select(F.lit("u").alias("url"), "system", "code")
    for out in (K.validate_codes(facts, one, systems), K.lookup(facts, one, systems, none, props), K.validate_membership(facts.withColumn("url", F.lit("u")), expansion, one, expansion.select("url"), systems=systems)):
        assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert {r.id: r.version for r in K.lookup(facts, one, systems, none, props).collect()} == {1: "10", 2: "10", 3: "1", 4: None, 5: None}


def test_facts_by_version(spark, small_world) -> None:  # noqa: ANN001
    systems, contents, releases = small_world
    held = VV.code_intervals(contents, releases)
    asked = [("s", "a", None), ("s", "a", "1"), ("s", "b", "2"), ("s", "b", "x"), ("s", "c", "2"), ("s", "c", "3"), ("t", "x", None), ("u", "a", "1")]
    facts = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "id int, system string, code string, version string")
    got = {r.id: (r.result, r.release, [x.reason for x in r.issues]) for r in K.validate_codes(facts, held, releases).collect()}
    assert got == {0: (True, "10", ["inactive"]), 1: (True, "1", []), 2: (False, "2", ["unknown-code"]), 3: (True, "10", []), 4: (True, "2", []), 5: (False, None, ["unknown-version"]), 6: (True, "1", ["case-differs"]), 7: (False, None, ["unknown-system"])}
    expansion = held.select(F.lit("u").alias("url"), "system", "code").distinct()
    inside = K.validate_membership(facts.withColumn("url", F.lit("u")), expansion, held, expansion.select("url"), active_only=True, systems=releases)
    assert {r.id: r.reason for r in inside.collect()} == {0: "inactive", 1: None, 2: "unknown-code", 3: None, 4: None, 5: "unknown-version", 6: None, 7: "unknown-code"}


def test_rules_by_version(spark, small_world) -> None:  # noqa: ANN001
    """A pinned rule gives its version's codes; one pinned to an absent version an error row; conditions of one rule meet inside a version."""
    systems, contents, releases = small_world
    empty = lambda kind: spark.createDataFrame([], kind)
    edges = spark.createDataFrame([("s", "a", "b", 1, 1), ("s", "a", "b", 3, 3), ("s", "c", "a", 2, 2)], "system string, child string, parent string, from_no int, to_no int")
    t = VS.SystemTables(VV.code_intervals(contents, releases).drop("key"), edges, empty("descendant string"), empty("system string, code string, property string, value_text string"), releases)
    rules = [
        *VS.rule("old", "include", 0, "s", version="1"), *VS.rule("new", "include", 0, "s"), *VS.rule("tree", "include", 0, "s", filters=[("concept", "is-a", "b")], version="1"), *VS.rule("tree", "include", 1, "s", filters=[("concept", "is-a", "a")], version="2"),
        *VS.rule("none", "include", 0, "s", version="99"), *VS.rule("mixed", "include", 0, "s", version="2", refs=["old"]), *VS.rule("same", "include", 0, "s", version="1", refs=["old"]), *VS.rule("blind", "include", 0, "t", codes=["X", "x"]),
    ]
    out, errors = VV.expand_versions(spark.createDataFrame(rules, VS.RULES), t, releases)
    got = sorted((r.url, r.version, r.code) for r in out.collect())
    assert got == [("blind", "1", "X"), ("new", "10", "a"), ("new", "10", "b"), ("old", "1", "a"), ("old", "1", "b"), ("same", "1", "a"), ("same", "1", "b"), ("tree", "1", "a"), ("tree", "1", "b"), ("tree", "2", "a"), ("tree", "2", "c")]
    assert [tuple(r) for r in errors.collect()] == [("none", "include", 0, "s", "99", "unknown-version")]


@pytest.mark.parametrize(("filters", "reason"), [
    ([("concept", "frobnicate", "true")], "unknown-operator"), ([("p", "frobnicate", "x")], "unknown-operator"), ([("concept", "is-a", "nobody")], "unknown-code"), ([("concept", "in", "a, nobody")], "unknown-code"),
    ([("parent", "in", "a")], "unsupported-operator"), ([("parent", "exists", "true")], "unsupported-operator"), ([("child", "=", "nobody")], "unknown-code"), ([("q", "=", "1")], "undeclared-property"), ([("p", "is-a", "1")], "unsupported-operator"), ([("p", "exists", "maybe")], "bad-value"),
])
def test_filters_are_refused(spark, filters, reason) -> None:  # noqa: ANN001
    """What once gave a whole system, or nothing, is an error."""
    concepts = spark.createDataFrame([("s", c, c, True, False, "m") for c in "abc"], "system string, code string, display string, active boolean, abstract boolean, module string")
    systems = spark.createDataFrame(SYSTEMS[:1], "system string, version string, case_sensitive boolean, content string")
    props = spark.createDataFrame([("s", "a", "p", "1")], "system string, code string, property string, value_text string")
    edges = spark.createDataFrame([("s", "b", "a")], "system string, child string, parent string")
    t = VS.SystemTables(concepts, edges, edges.select("system", F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("min_depth")), props, systems)
    rules = spark.createDataFrame([*VS.rule("u", "include", 0, "s", filters=filters), *VS.rule("v", "include", 0, "s", codes=["a"])], VS.RULES)
    with pytest.raises(ValueError, match=reason):
        VS.expand(rules, t)
    assert {r.reason for r in VS.refused(rules, t).collect()} == {reason}
    got = {(r.url, r.code) for r in VS.expand(rules, t, refuse=False).collect()}
    assert got == {("v", "a")} | ({("u", "a")} if filters[0][1] == "in" and filters[0][0] == "concept" else set())


def test_map_names_keep_their_bars(spark) -> None:  # noqa: ANN001
    release = spark.createDataFrame([("s", "a", True)], "system string, code string, active boolean")
    elements = spark.createDataFrame([("http://m|2", "s", "s", "a", "gone")], "map string, source_system string, target_system string, code string, target_code string")
    assert [tuple(r) for r in R.revalidate_maps(elements, release, "2").collect()] == [("http://m|2", "target", "s", "gone", "unknown", "2")]


def test_written_tables_keep_each_other(spark, tmp_path) -> None:  # noqa: ANN001
    """A second system, a second version, a version written again, and one with other columns; joins need no exchange on the table's side."""
    path = f"file://{tmp_path}/tables"
    table = lambda *codes: spark.createDataFrame([(c, f"{c}'s") for c in codes], "code string, display string")
    held = lambda: sorted((r._system, r._version, r.code) for r in W.read_tables(spark, path, "concepts").collect())
    for system, version, codes in (("a|x'y", "1", "pq"), ("b", "1", "qr"), ("a|x'y", "2", "s"), ("a|x'y", "1", "tu")):
        assert [tuple(r) for r in W.write_tables({"concepts": table(*codes)}, path, system, version, buckets=4).collect()] == [("concepts", len(codes))]
    assert held() == [("a|x'y", "1", "t"), ("a|x'y", "1", "u"), ("a|x'y", "2", "s"), ("b", "1", "q"), ("b", "1", "r")]
    assert W.drop_unlisted(spark, path, "concepts") == 1 and len(held()) == 5
    W.write_tables({"edges": table("z")}, path, "b", "1", buckets=4)
    assert len(held()) == 5 and sorted((r.name, r.system, r.version, r.rows) for r in W.manifest(spark, path).collect()) == [("concepts", "a|x'y", "1", 2), ("concepts", "a|x'y", "2", 1), ("concepts", "b", "1", 2), ("edges", "b", "1", 1)]

    def fails(x: int) -> int:
        raise RuntimeError

    broken = spark.range(3).select(F.udf(fails, "string")("id").alias("code"), F.lit("").alias("display"))
    with pytest.raises(Exception):  # noqa: B017
        W.write_tables({"concepts": broken}, path, "b", "1")
    assert len(held()) == 5
    facts = spark.range(100).select(F.col("id").cast("string").alias("code"), "id")
    plan = facts.join(W.read_tables(spark, path, "concepts").hint("merge"), "code")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    W.write_tables({"concepts": table("w").withColumn("more", F.lit(1))}, path, "c", "1", buckets=4)
    assert len(held()) == 6
