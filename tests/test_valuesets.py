"""Value sets that refer to each other, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import valuesets as VS

CODES = "abcdefgh"


@pytest.fixture(scope="module")
def tables(spark):  # noqa: ANN001, ANN201
    concepts = spark.createDataFrame([(s, c, c, True, False, "m") for s in "st" for c in CODES], "system string, code string, display string, active boolean, abstract boolean, module string")
    systems = spark.createDataFrame([(s, "1", True, "complete") for s in "st"], "system string, version string, case_sensitive boolean, content string")
    edges = spark.createDataFrame([("s", "b", "a")], "system string, child string, parent string")
    reach = edges.select("system", F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("min_depth"))
    return VS.SystemTables(concepts, edges, reach, spark.createDataFrame([], "system string, code string, property string, value_text string"), systems)


def brute(rules: list[tuple]) -> dict[str, set]:
    """Each set from its rules (url, side, no, system, codes, refs), the ones below first."""
    by: dict[str, list] = {}
    for url, *rest in rules:
        by.setdefault(url, []).append(rest)

    def content(url: str) -> set:
        sides = {"include": set(), "exclude": set()}
        for side, _, system, codes, refs in by.get(url, []):
            parts = [content(r) if system is None else {x for x in content(r) if x[0] == system} for r in refs]
            if codes:
                parts.append({(system, c) for c in codes})
            elif system and not refs:
                parts.append({(system, c) for c in CODES})
            if parts:
                sides[side] |= set.intersection(*parts)
        return sides["include"] - sides["exclude"]

    return {u: content(u) for u in by}


def rows(rules: list[tuple]) -> list[tuple]:
    return [r for url, side, no, system, codes, refs in rules for r in VS.rule(url, side, no, system, codes=list(codes), refs=list(refs))]


@pytest.mark.parametrize("seed", range(3))
def test_random_references(spark, tables, seed: int) -> None:  # noqa: ANN001
    pick = random.Random(seed)
    rules = []
    for i in range(24):
        below = [f"v{j}" for j in range(i)] + ["absent"]
        for no in range(pick.randrange(1, 4)):
            kind = pick.randrange(5)
            side = "include" if no == 0 or pick.random() < 0.7 else "exclude"
            refs = tuple(pick.sample(below, min(len(below), pick.choice([1, 1, 2])))) if kind >= 2 else ()
            system = pick.choice("st") if kind <= 2 else None
            codes = tuple(pick.sample(CODES, 4)) if kind in (0, 2) else ()
            rules.append((f"v{i}", side, no, system, codes, refs))
    got: dict[str, set] = {}
    out = VS.expand(spark.createDataFrame(rows(rules), VS.RULES), tables).collect()
    for r in out:
        got.setdefault(r.url, set()).add((r.system, r.code))
    assert sum(map(len, got.values())) == len(out)
    assert got == {u: x for u, x in brute(rules).items() if x}


def test_a_chain_takes_a_fixed_number_of_evaluations(spark, tables, monkeypatch) -> None:  # noqa: ANN001
    """Thirty sets, each the one below and a code more; and the same under an exclude."""
    rules = [("v0", "include", 0, "s", ("a",), ())]
    for i in range(1, 30):
        rules += [(f"v{i}", "include", 0, None, (), (f"v{i - 1}",)), (f"v{i}", "include", 1, "t", (CODES[i % 8],), ())]
    rules += [("top", "include", 0, None, (), ("v29",)), ("top", "exclude", 0, "t", ("c",), ())]
    evaluated, evaluate = [], VS._evaluate
    monkeypatch.setattr(VS, "_evaluate", lambda *a: evaluated.append(1) or evaluate(*a))
    out = VS.expand(spark.createDataFrame(rows(rules), VS.RULES), tables).collect()
    got: dict[str, set] = {}
    for r in out:
        got.setdefault(r.url, set()).add((r.system, r.code))
    assert len(evaluated) == 2 and got == brute(rules)
    assert {(r.rule_no, r.concept_no) for r in out if r.url == "v29" and r.system == "s"} == {(0, 0)}


@pytest.mark.parametrize("rules", [
    [("x", "include", 0, None, (), ("x",))], [("x", "include", 0, None, (), ("y",)), ("y", "include", 0, None, (), ("x",))],
    [("x", "include", 0, None, (), ("y",)), ("x", "exclude", 0, "s", ("a",), ()), ("y", "include", 0, None, (), ("x",))],
])
def test_circles(spark, tables, rules) -> None:  # noqa: ANN001
    with pytest.raises(ValueError, match="circle"):
        VS.expand(spark.createDataFrame(rows(rules), VS.RULES), tables)
