"""What moves: rows meet their key once, and results are those of small cases by hand."""

from __future__ import annotations

from termloom.operators import hierarchy as H
from termloom.operators import systems as Y


def exchanges(df) -> list[str]:  # noqa: ANN001
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(" in line]


def test_normal_forms_move_once_by_source(spark) -> None:  # noqa: ANN001
    attributes = spark.createDataFrame([("a", 0, "k", "t", None, None), ("a", 0, "n", None, 1.5, None), ("a", 2, "k", "u", None, None), ("a", 1, "s", None, None, "x"), ("b", 1, "k", "t", None, None)], "source string, role_group int, kind string, target string, number double, text string")
    edges = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "p"), ("c", "p")], "child string, parent string")
    terms = spark.createDataFrame([("t", "tea"), ("k", "kind"), ("p", "pa")], "code string, display string")
    forms = Y.normal_form_table(edges, attributes)
    assert dict(map(tuple, forms.collect())) == {"a": 'p+q:k=t,n=#1.50,{k=u},{s="x"}', "b": "{k=t}", "c": "p"}
    assert len(exchanges(Y.normal_form_table(edges, attributes))) == 2
    named = Y.normal_form_table(edges, attributes, terms)
    assert dict(map(tuple, named.collect())) == {"a": 'p |pa|+q:k |kind|=t |tea|,n=#1.50,{k |kind|=u},{s="x"}', "b": "{k |kind|=t |tea|}", "c": "p |pa|"}
    assert not any("role_group" in line for line in exchanges(named))


def test_axes_are_found_once_a_value(spark) -> None:  # noqa: ANN001
    scales = spark.createDataFrame([("s", "one", True, 0, "x"), ("s", "two", False, 1, "x"), ("s", "two", False, 1, "y"), ("other", "one", True, 0, "z")], "stem string, axis string, required boolean, declared int, entity string")
    closure = spark.createDataFrame([("v", "x"), ("v", "y"), ("w", "y"), ("u", "z")], "descendant string, ancestor string")
    asked = spark.createDataFrame([(1, "s", "v", []), (2, "s", "v", ["one"]), (3, "s", "v", ["one", "two"]), (4, "s", "w", None), (5, "s", "u", []), (6, "other", "z", [None])], "id int, stem string, value string, filled array<string>")
    got = Y.axis_value_check(asked, scales, closure)
    assert {r.id: r.axis for r in got.collect()} == {1: "one", 2: "two", 3: "one", 4: "two", 5: None, 6: "one"}
    assert not any("(id" in line for line in exchanges(got))


def test_closure_pairs_meet_new_codes_once(spark) -> None:  # noqa: ANN001
    closure = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")], "descendant string, ancestor string")
    code = lambda *x: spark.createDataFrame([(c,) for c in x], "code string")
    got = H.closure_delta(code("a", "c"), code("b", "c", "e"), closure)
    assert sorted((r.source, r.target) for r in got.collect()) == [("a", "b"), ("b", "c")]
    assert not any("hashpartitioning(source" in line for line in exchanges(got))
