"""What walks from the codes that are named, and what is moved no more than is needed: results are those of small cases by hand."""

from __future__ import annotations

from dataclasses import replace

import pytest

from termloom.operators import hierarchy as H
from termloom.operators import valuesets as VS

EDGES = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "a"), ("e", "d"), ("x", "e"), ("e", "x"), ("q", "p"), ("q", "q"), ("r", None)]


@pytest.fixture(scope="module")
def edges(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(EDGES, "child string, parent string")


def refuse() -> None:
    raise AssertionError("the whole closure is not needed")


def test_reached_is_what_the_closure_says(spark, edges, monkeypatch) -> None:  # noqa: ANN001
    code = lambda *x: spark.createDataFrame([(c,) for c in x], "code string")
    pairs = lambda df: sorted((r.start, r.code) for r in df.collect())
    assert pairs(H.reached(code("b", "d", "p", "b", None, "none"), edges)) == [("b", "c"), ("b", "d"), ("b", "e"), ("b", "x"), ("d", "e"), ("d", "x"), ("p", "q")]
    assert pairs(H.reached(code("c", "q"), edges, up=True)) == [("c", "a"), ("c", "b"), ("q", "p")]
    assert sorted(r.code for r in H.below(code("b"), edges, refuse).collect()) == ["c", "d", "e", "x"]
    monkeypatch.setattr(H, "LEVELS", 1)
    assert H.reached(code("a"), edges) is None
    assert sorted(r.code for r in H.below(code("a"), edges, lambda: H.transitive_closure(edges)).collect()) == ["b", "c", "d", "e", "x"]


@pytest.fixture(scope="module")
def tables(spark):  # noqa: ANN001, ANN201
    concepts = spark.createDataFrame([(s, c, c, True, False, "m") for s in "st" for c in "abcd"], "system string, code string, display string, active boolean, abstract boolean, module string")
    systems = spark.createDataFrame([(s, "1", True, "complete") for s in "st"], "system string, version string, case_sensitive boolean, content string")
    edges = spark.createDataFrame([("s", "b", "a"), ("s", "c", "b"), ("s", "d", "b"), ("t", "b", "a")], "system string, child string, parent string")
    return VS.SystemTables(concepts, edges, refuse, spark.createDataFrame([], "system string, code string, property string, value_text string"), systems)


def test_tree_filters_need_no_closure(spark, tables) -> None:  # noqa: ANN001
    """a rule walks from the codes that it names."""
    made = [r for op, value in (("is-a", "b"), ("descendent-of", "a"), ("generalizes", "c"), ("descendent-leaf", "a"), ("is-not-a", "b")) for r in VS.rule(op, "include", 0, "s", filters=[("concept", op, value)])]
    got: dict[str, str] = {}
    for r in VS.expand(spark.createDataFrame(made, VS.RULES), tables).orderBy("url", "code").collect():
        got[r.url] = got.get(r.url, "") + r.code
    assert got == {"is-a": "bcd", "descendent-of": "bcd", "generalizes": "abc", "descendent-leaf": "cd", "is-not-a": "a"}


def test_excludes_that_test_codes_are_read_row_by_row(spark, tables, monkeypatch) -> None:  # noqa: ANN001
    written, cut = [], VS.cut
    monkeypatch.setattr(VS, "cut", lambda df, name="cut", **more: written.append(name) or cut(df, name, **more))
    made = [
        *VS.rule("v", "include", 0, "s", filters=[("concept", "is-a", "a")]), *VS.rule("v", "include", 1, "t"),
        *VS.rule("v", "exclude", 0, "s", filters=[("code", "regex", "[bc]"), ("code", "not-in", "c")]), *VS.rule("v", "exclude", 1, "s", filters=[("code", "regex", "d")]), *VS.rule("v", "exclude", 2, "t", filters=[("code", "exists", "false")]),
        *VS.rule("w", "include", 0, "t"), *VS.rule("w", "include", 1, "s"), *VS.rule("w", "exclude", 0, "t"),
    ]
    out = VS.expand(spark.createDataFrame(made, VS.RULES), tables).collect()
    assert sorted(f"{r.url}{r.system}{r.code}" for r in out) == ["vsa", "vsc", "vta", "vtb", "vtc", "vtd", "wsa", "wsb", "wsc", "wsd"]
    assert "included" not in written


def test_contains_takes_rules_contents_alone(spark, tables, monkeypatch) -> None:  # noqa: ANN001
    """of sets that are drawn on but not asked for nothing is given, and codes do not meet the concepts again."""
    monkeypatch.setattr(VS, "expand", lambda *a, **k: refuse())
    made = [*VS.rule("one", "include", 0, "s", filters=[("concept", "is-a", "b")]), *VS.rule("two", "include", 0, None, refs=["one"]), *VS.rule("two", "exclude", 0, "s", filters=[("code", "regex", "c")])]
    asked = spark.createDataFrame([("two", "s", c) for c in "abcdz"] + [("two", "s", "b")], "url string, system string, code string")
    got = VS.contains(asked, spark.createDataFrame(made, VS.RULES), replace(tables, closure=refuse))
    assert sorted(f"{r.code}{r.inside:d}" for r in got.collect()) == ["a0", "b1", "b1", "c0", "d1", "z0"]


def test_walks_go_on_from_inner_codes_alone(spark, monkeypatch) -> None:  # noqa: ANN001
    """F16, F24, F17: places need no closure, no round is begun from leaves, and doubled edges, circles and codes outside change nothing."""
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("c", "out"), ("z", "out"), ("in", "d"), ("s", "s")], "child string, parent string")
    codes = spark.createDataFrame([(c,) for c in ("a", "b", "c", "d", "x", "y", "z", "s")], "code string")
    closure = H.transitive_closure
    monkeypatch.setattr(H, "transitive_closure", lambda *a: refuse())
    got = {r.code: (r.place, r.last) for r in H.preorder_numbers(codes, edges).collect()}
    assert got == {"a": (0, 3), "b": (1, 2), "d": (2, 2), "c": (3, 3), "z": (4, 4), "s": (5, 5), "x": (6, 6), "y": (7, 7)}
    monkeypatch.setattr(H, "transitive_closure", closure)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("c", "d"), ("d", "c"), ("a", "d"), ("b", "c"), ("x", "y"), ("z", "z"), ("a", "none"), ("c", "d")])], "id int, a string, b string")
    out = H.subsumes_by_labels(pairs, *H.interval_labels(codes, edges))
    assert out.columns == ["id", "a", "b", "outcome"]
    assert {r.id: r.outcome for r in out.collect()} == {0: "subsumes", 1: "subsumed-by", 2: "subsumes", 3: "not-subsumed", 4: "subsumes", 5: "equivalent", 6: "not-subsumed", 7: "subsumes"}


def test_closure_ends_where_nothing_lies_above(spark, monkeypatch) -> None:  # noqa: ANN001
    """of pairs at the top no further round is written."""
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "b"), ("e", "d")], "child string, parent string")
    paths, new_path = [], H.new_path
    monkeypatch.setattr(H, "new_path", lambda s, name: paths.append(new_path(s, name)) or paths[-1])
    got = sorted(map(tuple, H.transitive_closure(edges).collect()))
    assert got == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("d", "a", 2), ("d", "b", 1), ("d", "c", 1), ("e", "a", 3), ("e", "b", 2), ("e", "c", 2), ("e", "d", 1)]
    rounds = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert len(rounds.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(rounds)) == 3


def test_releases_asked_are_read_once(spark, monkeypatch) -> None:  # noqa: ANN001
    """an expansion reads the concepts and edges of its releases again and again: they are written once."""
    from termloom.operators import versioned as VV

    written, cut = [], VV.cut
    monkeypatch.setattr(VV, "cut", lambda df, name="cut": written.append(name) or cut(df, name))
    releases = VV.number_releases(spark.createDataFrame([("s", v, True, "complete") for v in ("1", "2")], "system string, version string, case_sensitive boolean, content string"))
    contents = spark.createDataFrame([("s", v, c, c, True, False, "m") for v, codes in (("1", "abc"), ("2", "ab")) for c in codes], "system string, version string, code string, display string, active boolean, abstract boolean, module string")
    edges = spark.createDataFrame([("s", "b", "a", 1, 2), ("s", "c", "b", 1, 1)], "system string, child string, parent string, from_no int, to_no int")
    t = VS.SystemTables(VV.code_intervals(contents, releases).drop("key"), edges, refuse, spark.createDataFrame([], "system string, code string, property string, value_text string"), releases)
    rules = [r for v in ("1", "2") for r in VS.rule(f"v{v}", "include", 0, "s", filters=[("concept", "is-a", "a")], version=v)]
    out, _ = VV.expand_versions(spark.createDataFrame(rules, VS.RULES), t, releases)
    assert sorted(f"{r.url}{r.version}{r.code}" for r in out.collect()) == ["v11a", "v11b", "v11c", "v22a", "v22b"]
    assert {"edges-asked", "concepts-asked"} <= set(written)


def test_numbers_are_of_all_concepts(spark) -> None:  # noqa: ANN001
    """the query gives orders their places too, one row a concept: leaves below their customers, whose ranges are of as many places as they have orders."""
    from termloom.plans import QUERIES

    data = "/root/testdata/sf0.001"
    got = {r.code: (r.place, r.last) for r in QUERIES["preorder_numbers"](spark, data).collect()}
    assert got.keys() == {r.code for r in QUERIES["ecl_any"](spark, data).collect()}
    assert sorted(place for place, _ in got.values()) == list(range(len(got)))
    orders: dict[str, list[int]] = {}
    for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        place, last = got[f"O:{r.o_orderkey}"]
        assert place == last
        orders.setdefault(f"C:{r.o_custkey}", []).append(place)
    customers = {code: span for code, span in got.items() if code.startswith("C:")}
    assert all(sorted(orders.get(code, [])) == list(range(place + 1, last + 1)) for code, (place, last) in customers.items())
