"""Closures that follow their edges, interval labels and constraint rows, on random graphs against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import constraints as CS
from termloom.operators import hierarchy as H


def reach(edges: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    up: dict[str, set] = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out: dict[tuple[str, str], int] = {}
    for start in up:
        seen, level, depth = {start}, {start}, 0
        while level:
            depth += 1
            level = {p for c in level for p in up.get(c, ())} - seen
            seen |= level
            out |= {(start, p): depth for p in level}
    return out


def graph(pick: random.Random, n: int, m: int, circles: bool = False) -> set[tuple[str, str]]:
    pairs = [tuple(pick.sample(range(n), 2)) for _ in range(m)]
    return {(f"n{a}", f"n{b}") if circles else (f"n{max(a, b)}", f"n{min(a, b)}") for a, b in pairs}


@pytest.mark.parametrize("seed", range(3))
def test_a_maintained_closure_equals_a_rebuilt_one(spark, seed: int) -> None:  # noqa: ANN001
    """Several changes in a row, of edges that are there and that are not, with and without circles."""
    pick = random.Random(seed)
    edges = graph(pick, 30, 45, seed == 2)
    df = lambda e: spark.createDataFrame(sorted(e), "child string, parent string")
    frame = df(edges)
    closure = H.transitive_closure(frame)
    for _ in range(2):
        removed, added = set(pick.sample(sorted(edges), 6)) | {("none", "n1")}, graph(pick, 33, 7, seed == 2)
        edges = (edges - removed) | added
        closure, frame = H.maintain_closure(closure, frame, df(added), df(removed))
        assert {(r.child, r.parent) for r in frame.collect()} == edges
        rows = closure.collect()
        assert {(r.descendant, r.ancestor): r.min_depth for r in rows} == reach(edges) and len(rows) == len(reach(edges))
    same, _ = H.maintain_closure(closure, frame)
    assert {(r.descendant, r.ancestor) for r in same.collect()} == set(reach(edges))


@pytest.mark.parametrize("seed", range(3))
def test_interval_labels_tell_what_the_closure_does(spark, seed: int) -> None:  # noqa: ANN001
    pick = random.Random(seed + 10)
    edges, codes = graph(pick, 40, 60), [f"n{i}" for i in range(42)]
    concepts = spark.createDataFrame([(c,) for c in codes], "code string")
    labels, cover = H.interval_labels(concepts, spark.createDataFrame(sorted(edges), "child string, parent string"))
    place = {r.code: r.place for r in labels.collect()}
    assert sorted(place.values()) == list(range(42))
    spans: dict[str, list] = {}
    for r in cover.collect():
        spans.setdefault(r.code, []).append((r.low, r.high))
    for spans_of in spans.values():  # apart from each other, so none could be left out
        spans_of.sort()
        assert all(a[1] + 1 < b[0] for a, b in zip(spans_of, spans_of[1:]))
    want = reach(edges)
    below = {(d, a) for d in codes for a in codes if d != a and any(low <= place[d] <= high for low, high in spans[a])}
    assert below == set(want)
    pairs = [(pick.choice(codes), pick.choice(codes)) for _ in range(200)]
    got = H.subsumes_by_labels(spark.createDataFrame(pairs, "a string, b string"), labels, cover).collect()
    assert len(got) == 200
    for r in got:
        assert r.outcome == ("equivalent" if r.a == r.b else "subsumes" if (r.b, r.a) in want else "subsumed-by" if (r.a, r.b) in want else "not-subsumed")


def test_pages_of_any_depth(spark) -> None:  # noqa: ANN001
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    for offset, count in ((0, 3), (4990, 50), (2500, 0), (6000, 5), (1234, 100)):
        got = sorted((r.place, r.x, r.total) for r in H.page(rows, [F.col("x")], offset, count).collect())
        assert got == [(i, i, 5000) for i in range(offset, min(5000, offset + count))]
    plan = H.page(rows, [F.col("x")], 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert H.page(rows.limit(0), [F.col("x")], 0, 5).count() == 0


def brute(tree: object, rows: list[tuple], sets: dict[str, set]) -> bool:
    """rows of one source: (group, row_id, kind, target, number, text)."""

    def matches(t: CS.Test, r: tuple) -> bool:
        if t.kind is not None and t.kind != r[2]:
            return False
        if t.value is None:
            return True
        if isinstance(t.value, str):
            return r[3] is not None and (r[3] in sets[t.value]) != t.negate
        how, x = t.value
        own = r[5] if isinstance(x, str) else r[4]
        fits = own is not None and {"=": own == x, "!=": own != x, "<": own < x, "<=": own <= x, ">": own > x, ">=": own >= x}[how]
        return fits != t.negate

    def within(n: int, node: object) -> bool:
        return n >= node.least and (node.most is None or n <= node.most)

    def run(node: object, part: list[tuple]) -> bool:
        if isinstance(node, CS.And):
            return all(run(x, part) for x in node.parts)
        if isinstance(node, CS.Or):
            return any(run(x, part) for x in node.parts)
        if isinstance(node, CS.Not):
            return not run(node.part, part)
        if isinstance(node, CS.Group):
            groups: dict[object, list] = {}
            for r in part:
                groups.setdefault(r[0] or ("row", r[1]), []).append(r)
            return within(sum(run(node.inside, g) for g in groups.values()), node)
        return within(sum(matches(node, r) for r in part), node)

    return run(tree, rows)


def test_constraints_against_brute_force(spark) -> None:  # noqa: ANN001
    """Random trees, nested inside role groups too, over sources with none to many rows."""
    pick = random.Random(4)
    attributes, by, row = [], {f"s{i}": [] for i in range(25)}, 0
    for source, own in by.items():
        for _ in range(pick.choice([0, 1, 3, 8])):
            kind = pick.choice("abc")
            target, number, text = (pick.choice("xyz"), None, None) if kind == "a" else (None, float(pick.randrange(5)), None) if kind == "b" else (None, None, pick.choice(["p", "q"]))
            group = pick.randrange(3)
            own.append((group, row, kind, target, number, text))
            attributes.append((source, group, row, kind, target, number, text))
            row += 1
    sets = {"one": {"x"}, "two": {"x", "y"}, "empty": set()}

    def leaf() -> CS.Test:
        kind = pick.choice(["a", "b", "c", None])
        value = {"a": pick.choice(["one", "two", "empty", None]), "b": pick.choice([(pick.choice(CS.HOWS), pick.randrange(5)), None]), "c": pick.choice([("=", "p"), ("!=", "p"), None]), None: None}[kind]
        least = pick.choice([1, 1, 0, 2])
        return CS.Test(kind, value, bool(value) and pick.random() < 0.3, least, pick.choice([None, None, least, least + 1]))

    def tree(depth: int, group: bool = False) -> object:
        kind = pick.randrange(4 if depth else 1)
        if kind == 0 and not group and pick.random() < 0.6:
            least = pick.choice([1, 0, 2])
            return CS.Group(tree(2, True), least, pick.choice([None, least]))
        return leaf() if kind == 0 else CS.Not(tree(depth - 1, group)) if kind == 1 else (CS.And if kind == 2 else CS.Or)(*[tree(depth - 1, group) for _ in range(pick.randrange(1, 4))])

    trees = {f"t{i}": tree(3) for i in range(60)}
    focus = spark.createDataFrame([(t, s) for t in trees for s in [*by, "bare"]], "constraint_id string, code string")
    rows = spark.createDataFrame(attributes, "source string, role_group int, row_id long, kind string, target string, number double, text string")
    held = spark.createDataFrame([(n, c) for n, x in sets.items() for c in x], "set_name string, code string")
    got = [tuple(r) for r in CS.select_all(focus, rows, *CS.frames(spark, trees), held).collect()]
    want = {(t, s) for t, x in trees.items() for s, own in [*by.items(), ("bare", [])] if brute(x, own, sets)}
    assert len(got) == len(set(got)) and set(got) == want
    assert 100 < len(want) < 60 * 26 - 100
    with pytest.raises(ValueError):
        CS.as_rows("t", CS.Group(CS.Group(CS.Test("a"))))


def test_constraints_of_domains(spark) -> None:  # noqa: ANN001
    """Constraints that share tests and are asked of shared domains, short ones and ones of many tokens: what matches does not multiply by the constraints that share a test."""
    pick, sets = random.Random(5), {"one": {"x"}, "two": {"x", "y"}}
    by = {f"s{i}": [(pick.randrange(3), 100 * i + r, *pick.choice([("a", pick.choice("xyz"), None, None), ("b", None, float(pick.randrange(5)), None)])) for r in range(i % 7)] for i in range(25)}
    trees = {f"t{i}": CS.And(CS.Group(CS.And(CS.Test("a", pick.choice(["one", "two"])), CS.Test("b", (">", 1))), least=pick.choice([0, 1, 2])), CS.Not(CS.Test("b", ("=", i % 5)))) for i in range(30)}
    trees |= {f"o{i}": CS.Or(CS.Test("a", "one", least=2), CS.Group(CS.Not(CS.Test("b", ("<", i))), least=2)) for i in range(5)}
    trees["long"] = CS.And(*[CS.Or(CS.Test("a", "two"), CS.Not(CS.Test("b", ("=", i % 4)))) for i in range(40)])
    rows = spark.createDataFrame([(s, *r) for s, own in by.items() for r in own], "source string, role_group int, row_id long, kind string, target string, number double, text string")
    held = spark.createDataFrame([(n, c) for n, x in sets.items() for c in x], "set_name string, code string")
    codes = {"all": [*by, "bare"], "odd": [s for s in by if int(s[1:]) % 2]}
    domains = spark.createDataFrame([(d, c) for d, x in codes.items() for c in x], "domain string, code string")
    asked = [(t, "odd" if i % 2 else "all") for i, t in enumerate(trees)] + [("t1", "all")]
    tests, groups, constraints = CS.frames(spark, trees)
    got = [tuple(r) for r in CS.select_all(spark.createDataFrame(asked, "constraint_id string, domain string"), rows, tests, groups, constraints, held, domains).collect()]
    want = {(t, c) for t, d in asked for c in codes[d] if brute(trees[t], [r for r in by.get(c, [])], sets)}
    assert len(got) == len(set(got)) and set(got) == want
    apart = CS.numbered_tests(tests)[0]
    distinct = apart.count()
    assert distinct < tests.count() / 3 and CS.matching(rows, apart, held).count() <= distinct * rows.count()
    assert CS.matching(rows, apart, held).groupBy("test", "source", "role_group", "row").count().filter("row IS NOT NULL AND count > 1").isEmpty()
