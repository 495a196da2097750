"""Golden sets, laws and edge cases of the operators on small tables."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import identifiers as I
from termloom.functions.text import fold, tokens, wildcard_regex
from termloom.functions.versions import version_matches
from termloom.operators import codes as K
from termloom.operators import concepts as C
from termloom.operators import hierarchy as H
from termloom.operators import search as S
from termloom.operators import valuesets as VS
from termloom.sources import rf2

EDGES = [("animal", "top"), ("cat", "animal"), ("dog", "animal"), ("fur", "top"), ("pets", "top")]
CONCEPTS = ["top", "animal", "cat", "dog", "fur", "pets", "fish"]
ATTRIBUTES = [("cat", 1, "covering", "fur", None), ("cat", 1, "legs", None, 4.0), ("dog", 1, "covering", "fur", None), ("dog", 2, "legs", None, 4.0), ("fur", 0, "covering", "fur", None), ("fur", 0, "legs", None, 4.0)]


@pytest.fixture(scope="module")
def t(spark):  # noqa: ANN001, ANN201
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    concepts = spark.createDataFrame([(c, c != "fish") for c in CONCEPTS], "code string, active boolean")
    attributes = spark.createDataFrame([(*a[:3], a[3], a[4], None) for a in ATTRIBUTES], "source string, role_group int, kind string, target string, number double, text string").withColumn("row_id", F.monotonically_increasing_id())
    members = spark.createDataFrame([("pets", "cat", True, {}), ("pets", "dog", True, {}), ("same-as", "fish", True, {"targetComponentId": "cat"}), ("pets", "fur", False, {})], "refset_id string, code string, active boolean, fields map<string,string>")
    return C.Terminology(concepts, edges, H.transitive_closure(edges), attributes, members)


def codes(s: C.ConceptSet) -> set[str]:
    return {r[0] for r in s.df.collect()}


def test_golden_sets(t) -> None:  # noqa: ANN001
    assert codes(t.concept("animal").descendants()) == {"cat", "dog"}
    assert codes(t.concept("animal").descendants(True)) == {"animal", "cat", "dog"}
    assert codes(t.concept("cat").ancestors()) == {"top", "animal"}
    assert codes(t.concept("cat").parents()) == {"animal"}
    assert codes(t.concept("animal").descendants(True).top()) == {"animal"}
    assert codes(t.concept("animal").descendants(True).bottom()) == {"cat", "dog"}
    assert codes(t.concept("pets").members().ancestors(True)) == {"top", "animal", "cat", "dog"}
    assert codes(t.concept("cat").history(["same-as"])) == {"cat", "fish"}
    with pytest.raises(C.UnknownConcept):
        t.concept("cow")
    with pytest.raises(C.UnknownConcept):
        t.concept("cat").members()


def test_groups(t) -> None:  # noqa: ANN001
    both = [C.AttributeTest(["covering"], t.concept("fur").df), C.AttributeTest(["legs"], ("=", 4))]
    assert codes(t.all().where_group(both)) == {"cat"}  # the dog has them in two groups, fur in group 0
    assert codes(t.all().where_group(both, least=0, most=0)) == set(CONCEPTS) - {"cat"}
    assert codes(t.all().where_attribute(C.AttributeTest(["legs"], None, least=0, most=0))) == {"top", "animal", "pets", "fish"}


def test_groups_by_table_and_value(t) -> None:  # noqa: ANN001
    """Tests of tables and of values in one group, joined by or, and groups that fit without a match."""
    fur, legs = C.AttributeTest(["covering"], t.concept("fur").df), C.AttributeTest(["legs"], ("=", 4))
    assert codes(t.all().where_group([fur, legs], "or", least=2)) == {"dog", "fur"}
    assert codes(t.all().where_group([fur, C.AttributeTest(["legs"], None, least=0, most=0)])) == {"dog", "fur"}
    none = C.AttributeTest(["color"], None, least=0, most=0)
    assert codes(t.all().where_group([none])) == {"cat", "dog", "fur"}
    assert codes(t.all().where_group([none, C.AttributeTest(["legs"], ("=", 4))], "or", least=2)) == {"dog", "fur"}
    assert codes(t.all().where_group([none, C.AttributeTest(["legs"], ("!=", 4))])) == set()
    outside = C.AttributeTest(["covering"], t.concept("fur").df, negate=True)
    assert codes(t.all().where_group([outside])) == set()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] < e[1]), min_size=1, max_size=20))
def test_closure_is_reachability(spark, pairs: set[tuple[int, int]]) -> None:  # noqa: ANN001
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "child string, parent string")
    reach = {p: {b for a, b in pairs if a == p} for p in range(13)}
    for p in sorted(reach, reverse=True):
        reach[p] |= {x for q in set(reach[p]) for x in reach[q]}
    want = {(str(p), str(q)) for p in reach for q in reach[p]}
    assert {(r[0], r[1]) for r in H.transitive_closure(edges).collect()} == want


def test_cycles(spark) -> None:  # noqa: ANN001
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")], "child string, parent string")
    assert {r[0] for r in H.detect_cycles(edges).collect()} == {"a", "b", "c"}


def test_closure_table_refuses_changed_content(t) -> None:  # noqa: ANN001
    table = H.ClosureTable.init(t.closure, "1").extend(t.concept("cat", "animal").df, t.closure, "1")
    assert table.version == 1 and table.since(0).count() == 1 and table.extend(t.concept("cat").df, t.closure, "1").version == 1
    with pytest.raises(ValueError, match="changed"):
        table.extend(t.concept("dog").df, t.closure, "2")


def test_reference_circle_is_refused(spark) -> None:  # noqa: ANN001
    rules = spark.createDataFrame([*VS.rule("a", "include", 0, None, refs=["b"]), *VS.rule("b", "include", 0, None, refs=["a"])], VS.RULES)
    with pytest.raises(ValueError, match="circle"):
        VS.expand(rules, None)


def test_text(spark) -> None:  # noqa: ANN001
    row = spark.range(1).select(fold(F.lit("Ñandú Straße ÉCOLE é")).alias("f"), tokens(F.lit("b a, A-ä")).alias("t")).first()
    assert row.f == "nandu straße ecole e" and row.t == ["a", "b"]
    assert wildcard_regex(r"a*\*.b") == r"(?is)^a.*\*\.b$"


@pytest.mark.parametrize(("version", "pattern", "fits"), [("1.2.3", "1.x.x", True), ("1", "1.x.x", True), ("01.2", "1.x", True), ("2.0", "1.x", False), ("1.2.3", "1.x", False), ("1.0", "1.0", True)])
def test_version_patterns(spark, version: str, pattern: str, fits: bool) -> None:  # noqa: ANN001
    assert spark.range(1).select(version_matches(F.lit(version), F.lit(pattern))).first()[0] is fits


def test_identifiers(spark) -> None:  # noqa: ANN001
    ids = {"138875005": None, "404684003": None, "138875006": "check-digit", "0138875005": "leading-zero", "12": "length", "x": "not-digits", "138875995": "partition", "900000000000000167": "check-digit"}
    df = spark.createDataFrame([(k,) for k in ids], "c string").select("c", I.concept_id_reason(F.col("c")).alias("r"), I.component_kind(F.col("c")).alias("k"))
    assert {r.c: r.r for r in df.collect()} == ids
    assert spark.range(1).select(I.mod10_digit(F.lit("7992739871"))).first()[0] == 3


def test_language_ranks() -> None:
    assert K.language_ranks("de, en;q=0.5, *;q=0.1, fr;q=0", ["en", "fr", "nl", "de-AT"]) == [("de-AT", 0), ("en", 1), ("nl", 2)]


def test_empty_inputs(spark, t) -> None:  # noqa: ANN001
    none = spark.createDataFrame([], "child string, parent string")
    assert H.transitive_closure(none).count() == 0 and H.detect_cycles(none).count() == 0
    assert C.top_of(t.all().df.limit(0), t.closure).count() == 0


def test_release_dates(spark) -> None:  # noqa: ANN001
    rows = [("Snapshot", 20260101), ("Snapshot", 20260201), ("Full", 20260101)]
    manifest = spark.createDataFrame(rows, "release_type string, date int")
    with pytest.raises(rf2.ReleaseError, match="several dates"):
        rf2.check_manifest(manifest)
    with pytest.raises(rf2.ReleaseError, match="no Delta"):
        rf2.check_manifest(manifest, "Delta")
    assert rf2.check_manifest(manifest, "Full") == 20260101


def test_core_plans_hold_no_python(spark) -> None:  # noqa: ANN001
    from termloom.plans import QUERIES

    for name in ("rollup_counts", "translate", "validate_codes", "prefix_search", "ecl_attribute_group"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan, name


def test_identifier_kinds(spark) -> None:  # noqa: ANN001
    from termloom.operators import systems as Y

    def with_digit(body: str) -> str:
        df = spark.createDataFrame([(body + str(d),) for d in range(10)], "c string")
        return df.filter(I.concept_id_reason(F.col("c")).isNull()).first().c

    expression = with_digit("1" + "1000005" + "16")  # a long identifier of an expression
    row = spark.createDataFrame([(expression,)], "c string").select(I.component_kind(F.col("c")).alias("k"), I.namespace(F.col("c")).alias("n")).first()
    assert (row.k, row.n) == ("expression", "1000005")
    numbers = spark.createDataFrame([("10449-7",), ("LP7751-1",), ("10449-6",), ("10449",), (None,)], "id string")
    assert {r.reason: r.n for r in Y.identifier_audit(numbers, kind="number").collect()} == {"ok": 2, "check-digit": 1, "shape": 2}


def test_editions(spark) -> None:  # noqa: ANN001
    """A namespaced root, the one of the release date among several, the core module, and what cannot be told."""
    from termloom.operators import systems as Y

    core, model, mapping = "900000000000207008", "900000000000012004", "449080006"
    dutch, other = "11000146104", "21000172104"
    kind = "module string, source_time int, target string, target_time int"
    base = [(core, 1, model, 1), (mapping, 1, core, 1), (mapping, 1, model, 1)]

    def picked(rows: list[tuple], date: int, strict: bool = False) -> list[str]:
        return [r.module for r in Y.identify_edition(spark.createDataFrame(rows, kind), core, date, strict).collect() if r.picked]

    assert picked(base, 1) == [core]  # the mapping module is the only root, and not the edition
    assert picked([*base, (dutch, 2, core, 1)], 9) == [dutch]
    both = [*base, (dutch, 2, core, 1), (other, 3, core, 1)]
    assert picked(both, 3) == [other] and picked(both, 9) == []
    with pytest.raises(Y.AmbiguousEdition):
        picked(both, 9, strict=True)
    assert picked([("449080006", 1, "450828004", 1)], 1) == ["449080006"]


def test_dialects(spark) -> None:  # noqa: ANN001
    terms = spark.createDataFrame([("d1", "c1"), ("d2", "c2"), ("d3", "c3")], "designation_id string, code string").withColumn("active", F.lit(True))
    sets = spark.createDataFrame([("d1", "900000000000508004", "preferred"), ("d2", "900000000000508004", "acceptable"), ("d3", "31000146106", "acceptable")], "designation_id string, refset_id string, acceptability string")
    found = lambda **more: {r.code for r in C.DescriptionTest(**more).rows(terms, sets).collect()}
    assert found(dialects={"en-GB": None}, acceptabilities=["preferred"]) == {"c1"}
    assert found(dialects={"en-gb": ["acceptable"], "NL-nl": None}, acceptabilities=["preferred"]) == {"c2"}
    assert found(dialects={"900000000000508004": None}) == {"c1", "c2"}
    with pytest.raises(C.UnknownConcept, match="alias"):
        found(dialects={"xx": None})


def test_folding_of_other_scripts(spark) -> None:  # noqa: ANN001
    rows = {"Ἀθῆναι": "αθηναι", "Ёлка": "елка", "שָׁלוֹם": "שלום", "ガ": "カ", "한글": "한글", "Łódź": "łodz", "क़": "क"}
    got = spark.createDataFrame([(k,) for k in rows], "c string").select("c", fold(F.col("c")).alias("f")).collect()
    assert {r.c: r.f for r in got} == rows


def test_versions_of_several_patterns(spark) -> None:  # noqa: ANN001
    facts = spark.createDataFrame([(1, "s", "1.2"), (2, "s", "2.9"), (3, "s", "3.0"), (4, "t", "5"), (5, "s", None)], "id int, system string, version string")
    used = spark.createDataFrame([("s", "1.x"), ("s", "2.x"), ("t", None)], "system string, pattern string")
    assert {r.id: r.version_ok for r in K.validate_version(facts, used).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def _tables(spark) -> VS.SystemTables:  # noqa: ANN001
    concepts = spark.createDataFrame([("s", c, f"name {c}", c != "D4") for c in ("A1", "B2", "C3", "D4")], "system string, code string, display string, active boolean").withColumn("abstract", F.lit(False))
    edges = spark.createDataFrame([("s", "B2", "A1"), ("s", "C3", "B2")], "system string, child string, parent string")
    closure = spark.createDataFrame([("s", "B2", "A1"), ("s", "C3", "A1"), ("s", "C3", "B2")], "system string, descendant string, ancestor string")
    properties = spark.createDataFrame([("s", "A1", "p", "x"), ("s", "B2", "p", "y"), ("s", "B2", "p", "z"), ("s", "C3", "q", "x")], "system string, code string, property string, value_text string")
    systems = spark.createDataFrame([("s", "1", False, "complete")], "system string, version string, case_sensitive boolean, content string")
    terms = spark.createDataFrame([("s", "C3", "Third thing", True), ("s", "D4", "Third old", False)], "system string, code string, term string, active boolean")
    return VS.SystemTables(concepts, edges, closure, properties, systems, designations=terms)


def test_filters_of_one_rule_meet_together(spark) -> None:  # noqa: ANN001
    """Positive, negative and pattern filters, alone and together, in whole expansions and for asked codes."""
    t = _tables(spark)
    cases = {
        "not": ([("p", "not-in", "y, w")], {"A1", "C3", "D4"}), "none": ([("p", "exists", "false")], {"C3", "D4"}), "any": ([("p", "exists", "true")], {"A1", "B2"}),
        "below-not": ([("concept", "is-a", "A1"), ("p", "not-in", "y"), ("code", "regex", "[AC].")], {"A1", "C3"}), "outside": ([("concept", "is-not-a", "B2")], {"A1", "D4"}),
        "both": ([("p", "regex", "[yz]"), ("p", "regex", "x|y")], {"B2"}), "one": ([("p", "in", "x, z"), ("concept", "descendent-of", "A1")], {"B2"}),
        "code": ([("concept", "in", "A1, D4"), ("code", "not-in", "A1")], {"D4"}), "never": ([("code", "exists", "false")], set()), "leaf": ([("concept", "descendent-leaf", "A1")], {"C3"}),
    }
    rules = spark.createDataFrame([r for k, (f, _) in cases.items() for r in VS.rule(k, "include", 0, "s", filters=f)], VS.RULES)
    got: dict[str, set] = {k: set() for k in cases}
    for r in VS.expand(rules, t).collect():
        got[r.url].add(r.code)
    assert got == {k: want for k, (_, want) in cases.items()}
    asked = spark.createDataFrame([(k, "s", c) for k in cases for c in ("a1", "b2", "C3", "d4", "none")], "url string, system string, code string")
    assert {(r.url, r.code.upper()) for r in VS.contains(asked, rules, t).collect() if r.inside} == {(k, c) for k, (_, want) in cases.items() for c in want}


def test_listed_codes_in_any_case_and_twice(spark) -> None:  # noqa: ANN001
    """A code that one rule lists twice, in two cases, and another rule once more comes once, at its first place and with the greater label of that rule."""
    t = _tables(spark)
    made = [*VS.rule("u", "include", 0, "s", codes=[("none", None), ("b2", "first"), ("B2", "second")]), *VS.rule("u", "include", 1, "s", codes=["B2", "C3"])]
    rows = {(r.code, r.rule_no, r.concept_no, r.display) for r in VS.expand(spark.createDataFrame(made, VS.RULES), t).collect()}
    assert rows == {("B2", 0, 1, "second"), ("C3", 1, 1, "name C3")}


def test_text_looks_at_designations(spark) -> None:  # noqa: ANN001
    t = _tables(spark)
    rules = spark.createDataFrame(VS.implicit("all", "s", url="u"), VS.RULES)
    assert {r.code for r in VS.expand(rules, t, text="third").collect()} == {"C3"} and VS.expand(rules, t, text="nam").count() == 4


def test_constraints_need_a_known_set(spark) -> None:  # noqa: ANN001
    from dataclasses import replace

    t = _tables(spark)
    rules = spark.createDataFrame(VS.implicit("constraint", "s", "mine", "u"), VS.RULES)
    named = VS.named_sets({"mine": ("s", spark.createDataFrame([("A1",), ("gone",)], "code string"))})
    assert [r.code for r in VS.expand(rules, replace(t, sets=named)).collect()] == ["A1"]
    for sets in (None, named.withColumn("value", F.lit("other"))):
        with pytest.raises(ValueError, match="set"):
            VS.expand(rules, replace(t, sets=sets)).collect()


def test_closure_of_a_long_chain_and_a_circle(spark) -> None:  # noqa: ANN001
    chain = [(f"{i}", f"{i + 1}") for i in range(200)]
    got = {(r[0], r[1]): r[2] for r in H.transitive_closure(spark.createDataFrame(chain, "child string, parent string")).collect()}
    assert got == {(f"{i}", f"{j}"): j - i for i in range(201) for j in range(i + 1, 201)}
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert {(r[0], r[1]): r[2] for r in H.transitive_closure(circle).collect()} == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_optional_part_only_hides_its_absence(monkeypatch) -> None:  # noqa: ANN001
    import importlib

    import __spark_entry__ as entry

    def missing(name: str):  # noqa: ANN202
        def load(_: str) -> None:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    for name in ("termloom.part", "termloom.part.queries"):
        monkeypatch.setattr(entry, "import_module", missing(name))
        assert entry._optional("termloom.part.queries") is None
    monkeypatch.setattr(entry, "import_module", missing("numpy"))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("termloom.part.queries")
    monkeypatch.setattr(entry, "import_module", importlib.import_module)


def test_short_pages(spark) -> None:  # noqa: ANN001
    """Pages from kept first hits equal those of all hits: short words alone, beside longer ones, repeated, without hits, with marks, and beyond what is kept."""
    made = ["Élan vital", "elk", "elk elm", "elder elm tree", "ash tree", "ash", "Ash grove elm", "", None, "el", "e", "oak-tree elm", "elm elm"] * 3
    names = spark.createDataFrame([(i, f"c{i % 7}", t) for i, t in enumerate(made)], "designation_id long, code string, term string")
    asked = ["e", "El", "é", "elm", "elm e", "a elm", "tree a", "tree e el", "el e", "x", "", None, "elder tr", "xylem e", "e e"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    index = S.ranked_index(names)
    short = S.short_pages(index, 2, 9)
    assert short.groupBy("start").count().filter("count > 9").isEmpty()
    hits = S.prefix_search(queries, S.inverted_index(names))
    for offset, count in ((0, 5), (4, 5), (2, 7), (6, 20)):
        want = sorted(map(tuple, S.rank_page(hits, names, offset, count).collect()))
        assert want and sorted(map(tuple, S.first_page(queries, index, names, offset, count, short, 2, 9).collect())) == want
        assert sorted(map(tuple, S.first_page(queries, index, names, offset, count).collect())) == want
