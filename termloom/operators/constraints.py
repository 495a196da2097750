"""Many constraints at once: tests, groups and programs as rows, evaluated for all constraints by one plan.

tests: constraint_id, test_no, group_no, kind, how, number, text, set_name, negate: a test matches attribute rows of its
kind (null: of any kind) whose number or text compares with its own, or whose target lies (negate: does not lie) in a named set; with none of
these, whatever their value. group_no 0 counts matching rows of the whole source; otherwise the test belongs to that group of its constraint.
groups: constraint_id, group_no, program: what has to hold inside one role group, over the rows of its tests there.
constraints: constraint_id, program: over ungrouped tests and over the number of role groups in which a group holds.
A program is a list of tokens (op, arg, least, most) in postfix order: `test` and `group` push whether the number of what
they name is between least and most (null: no end); `and`, `or` and `not` take their operands from the stack.
sets: set_name, code. focus: constraint_id, code, what each constraint is asked of.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.concepts import compare, compare_numbers
from termloom.tables import BROADCAST_ROWS, cut, small

TOKEN = "struct<op: string, arg: int, least: bigint, most: bigint>"
TESTS = "constraint_id string, test_no int, group_no int, kind string, how string, number double, text string, set_name string, negate boolean"
GROUPS = f"constraint_id string, group_no int, program array<{TOKEN}>"
CONSTRAINTS = f"constraint_id string, program array<{TOKEN}>"
#: Tokens of a program whose stack surely fits into a long.
SHORT = 60
HOWS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Test:
    """A leaf of a constraint; value is (comparison, number or text), or a set's name."""

    __test__ = False

    kind: str | None = None
    value: tuple | str | None = None
    negate: bool = False
    least: int = 1
    most: int | None = None


@dataclass(frozen=True)
class Group:
    """What holds inside one role group, in so many groups."""

    inside: object
    least: int = 1
    most: int | None = None


@dataclass(frozen=True)
class And:
    parts: tuple

    def __init__(self, *parts: object) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Or:
    parts: tuple

    def __init__(self, *parts: object) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Not:
    part: object


def as_rows(name: str, tree: object) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of tests, groups and constraints of one constraint, from a tree of Test, Group, And, Or and Not."""
    tests: list[tuple] = []
    groups: list[tuple] = []

    def program(node: object, group: int) -> list[tuple]:
        if isinstance(node, Test):
            how, number, text = None, None, None
            if isinstance(node.value, tuple):
                how, value = node.value
                number, text = (None, value) if isinstance(value, str) else (float(value), None)
            tests.append((name, len(tests), group, node.kind, how, number, text, node.value if isinstance(node.value, str) else None, node.negate))
            return [("test", len(tests) - 1, node.least, node.most)]
        if isinstance(node, Group):
            if group:
                raise ValueError("a role group cannot hold another")
            no = len(groups) + 1
            groups.append(())
            groups[no - 1] = (name, no, program(node.inside, no))
            return [("group", no, node.least, node.most)]
        if isinstance(node, Not):
            return [*program(node.part, group), ("not", None, None, None)]
        joint = ("and" if isinstance(node, And) else "or", None, None, None)
        first, *rest = [program(x, group) for x in node.parts]
        return reduce(lambda a, b: [*a, *b, joint], rest, first)

    whole = [(name, program(tree, 0))]
    return tests, groups, whole


def frames(spark: SparkSession, trees: dict[str, object]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tests, groups and constraints of named trees."""
    rows = [as_rows(name, tree) for name, tree in trees.items()]
    return tuple(spark.createDataFrame([r for x in rows for r in x[i]], schema) for i, schema in enumerate((TESTS, GROUPS, CONSTRAINTS)))


def holds(program: Column, number: Callable[[Column], Column]) -> Column:
    """Whether a program leaves true; number(token) is the number that a `test` or `group` token asks about. An empty program holds.

    The stack of a short program is the bits of a number, which is several times as fast as an array; a long one has an array.
    """
    at = lambda stack, i: F.get(stack, F.size(stack) - i)  # noqa: E731  from the top, 1 first

    def leaf(t: Column) -> Column:
        n, least = number(t), F.coalesce(t["least"], F.lit(0))
        return F.when(t["most"].isNull(), n >= least).otherwise(n.between(least, t["most"]))

    def step(stack: Column, t: Column) -> Column:
        two = lambda x: F.concat(F.slice(stack, F.lit(1), F.size(stack) - 2), F.array(x))
        return (
            F.when(t["op"] == "and", two(at(stack, 1) & at(stack, 2))).when(t["op"] == "or", two(at(stack, 1) | at(stack, 2)))
            .when(t["op"] == "not", F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(~at(stack, 1)))).otherwise(F.concat(stack, F.array(leaf(t))))
        )

    def bit(stack: Column, t: Column) -> Column:
        under = F.shiftright(stack, 1)
        return (
            F.when(t["op"].isin("test", "group"), F.shiftleft(stack, 1) + leaf(t).cast("long")).when(t["op"] == "and", under.bitwiseAND(stack.bitwiseOR(F.lit(-2))))
            .when(t["op"] == "or", under.bitwiseOR(stack.bitwiseAND(F.lit(1)))).otherwise(stack.bitwiseXOR(F.lit(1)))
        )

    short = F.aggregate(program, F.lit(0).cast("long"), bit, lambda stack: stack == 1)
    long = F.aggregate(program, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.lit(0)))
    return F.when(F.size(program) == 0, F.lit(True)).when(F.size(program) <= SHORT, short).otherwise(long)


def _of(found: Column) -> Callable[[Column], Column]:
    """The number that a token asks about, from a map."""
    return lambda t: F.coalesce(F.try_element_at(found, t["arg"]), F.lit(0).cast("long"))


def needed(program: Column, of_group: Callable[[Column], Column]) -> Column:
    """(tests, weight): tests of which one at least must match where a program holds; null where it may hold without any.

    Of two that must both match, the ones that fewer constraints share are taken. of_group(token) is what a role group needs.
    """
    kind = "struct<tests: array<bigint>, weight: bigint>"
    at = lambda stack, i: F.get(stack, F.size(stack) - i)

    def step(stack: Column, t: Column) -> Column:
        a, b = at(stack, 1), at(stack, 2)
        own = F.struct(F.array_compact(F.array(t["arg"])).alias("tests"), F.coalesce(t["shared"], F.lit(0).cast("long")).alias("weight"))
        leaf = F.when(F.coalesce(t["least"], F.lit(0)) > 0, F.when(t["op"] == "test", own).otherwise(of_group(t)))
        both = F.when(a.isNull(), b).when(b.isNull() | (a["weight"] <= b["weight"]), a).otherwise(b)
        either = F.when(a.isNotNull() & b.isNotNull(), F.struct(F.array_union(a["tests"], b["tests"]).alias("tests"), (a["weight"] + b["weight"]).alias("weight")))
        rest = lambda n: F.slice(stack, F.lit(1), F.size(stack) - n)
        return (
            F.when(t["op"] == "and", F.concat(rest(2), F.array(both))).when(t["op"] == "or", F.concat(rest(2), F.array(either)))
            .when(t["op"] == "not", F.concat(rest(1), F.array(F.lit(None).cast(kind)))).otherwise(F.concat(stack, F.array(leaf)))
        )

    return F.aggregate(program, F.array().cast(f"array<{kind}>"), step, lambda stack: F.get(stack, F.lit(0)))


def numbered_tests(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tests that differ (test, kind, how, number, text, set_name, negate), each once however many constraints have it; and (constraint_id, group_no, tests), a map from test_no to test and how many constraints share it."""
    columns = ["kind", "how", "number", "text", "set_name", "negate"]
    asked = tests.withColumn("negate", F.coalesce("negate", F.lit(False))).withColumn("_as", F.to_json(F.struct(*columns)))
    apart = asked.groupBy("_as").agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("shared"))
    apart = cut(apart.withColumn("test", F.monotonically_increasing_id()), "constraint-tests")
    own = asked.select("constraint_id", "group_no", "test_no", "_as").join(small(apart.select("_as", "test", "shared")), "_as")
    entry = F.struct("test_no", F.struct("test", "shared"))
    return apart.select("test", *columns), own.groupBy("constraint_id", "group_no").agg(F.map_from_entries(F.collect_list(entry)).alias("tests"))


def matching(attributes: DataFrame, tests: DataFrame, sets: DataFrame) -> DataFrame:
    """(test, source, role_group, row): one row for each attribute row that a test (see numbered_tests) matches.

    row is null but in role group 0. Tests meet rows by kind, those of sets by target; one row of attributes comes once for
    each test that it passes, however many constraints ask it, and for no others but those of its kind that compare.
    """
    row = F.when(F.col("role_group") == 0, F.col("row_id")).alias("row")
    rows = attributes.select("source", "role_group", row, "kind", "target", "number", "text")
    kinds = [r[0] for r in attributes.select("kind").distinct().collect()] if not tests.filter("kind IS NULL").isEmpty() else []  # the attributes' names, few
    named = tests.withColumn("kind", F.explode(F.when(F.col("kind").isNull(), F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")).otherwise(F.array("kind"))))
    wanted = named.select("test", "kind", "how", F.col("number").alias("_number"), F.col("text").alias("_text"), "set_name", "negate")
    plain = wanted.filter("set_name IS NULL").drop("set_name")
    fits = F.lit(False)
    for how in HOWS:
        own = F.when(F.col("_number").isNotNull(), compare_numbers(F.col("number"), how, F.col("_number"))).otherwise(compare(F.col("text"), how, F.col("_text")))
        fits = F.when(F.col("how") == how, own).otherwise(fits)
    by_value = rows.join(small(plain), "kind").filter(F.col("how").isNull() | (F.coalesce(fits, F.lit(False)) != F.col("negate")))
    of_sets = wanted.filter("set_name IS NOT NULL").select("test", "kind", "set_name", "negate")
    held = sets.select("set_name", F.col("code").alias("target")).distinct()
    targets = rows.filter("target IS NOT NULL").drop("number", "text")
    asked = of_sets.filter("NOT negate").drop("negate")
    within = targets.join(small(asked.select("kind").distinct()), "kind", "left_semi").join(held, "target").join(small(asked), ["kind", "set_name"])
    outside = targets.join(small(of_sets.filter("negate").drop("negate")), "kind").join(held, ["set_name", "target"], "left_anti")
    return reduce(DataFrame.unionByName, [df.select("test", "source", "role_group", "row") for df in (by_value, within, outside)])


def programs_of(tests: DataFrame, groups: DataFrame, constraints: DataFrame) -> DataFrame:
    """(constraint_id, program, groups, needs): programs over the numbers of tests (tests as numbered_tests maps them), role groups as a map, and the tests of which one must match; -1 alone where none must."""

    def renamed(program: Column) -> Column:
        def token(t: Column) -> Column:
            own = F.when(t["op"] == "test", F.try_element_at("tests", t["arg"]))
            arg = F.when(t["op"] == "test", own["test"]).otherwise(t["arg"].cast("long"))
            return F.struct(t["op"].alias("op"), arg.alias("arg"), t["least"].alias("least"), t["most"].alias("most"), own["shared"].alias("shared"))

        return F.transform(program, token)

    inside = groups.join(tests, ["constraint_id", "group_no"], "left").select("constraint_id", F.col("group_no").cast("long").alias("group_no"), renamed(F.col("program")).alias("program"))
    nothing = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    inside = inside.withColumn("alone", holds(F.col("program"), _of(nothing)))
    inside = inside.withColumn("need", F.when(~F.col("alone"), needed(F.col("program"), lambda t: F.lit(None).cast("struct<tests: array<bigint>, weight: bigint>"))))
    entry = F.struct("group_no", F.struct("program", "alone", "need"))
    per = inside.groupBy("constraint_id").agg(F.map_from_entries(F.collect_list(entry)).alias("groups"))
    whole = constraints.join(tests.filter("group_no = 0").drop("group_no"), "constraint_id", "left").select("constraint_id", renamed(F.col("program")).alias("program")).join(per, "constraint_id", "left")
    need = needed(F.col("program"), lambda t: F.try_element_at("groups", t["arg"])["need"])
    return whole.withColumn("needs", F.coalesce(need["tests"], F.array(F.lit(-1).cast("long"))))


def select_all(focus: DataFrame, attributes: DataFrame, tests: DataFrame, groups: DataFrame, constraints: DataFrame, sets: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """(constraint_id, code): the codes of each constraint's focus that it holds for.

    With domains (domain, code), focus is (constraint_id, domain): what many constraints are asked of comes once and not once for each.
    A test that many constraints share matches once. Matching rows move once, to the task of their source, where they are
    counted by test and role group; role groups in which the same tests match are one with a number. Each row of role group 0 is a group
    of its own. A source meets the constraints of which a needed test matches, and those that may hold without any match: there
    a role group that holds without matching rows counts too, so all groups are counted. A source without attributes has no groups.
    """
    if domains is None:
        domains, focus = focus.select(F.col("constraint_id").alias("domain"), "code"), constraints.select("constraint_id", F.col("constraint_id").alias("domain"))
    apart, own = numbered_tests(tests)
    programs = cut(programs_of(own, groups, constraints), "constraint-programs")
    hits = matching(attributes, apart, sets).repartition("source")
    counts = hits.groupBy("source", "role_group", "row", "test").agg(F.count(F.lit(1)).alias("n"))
    in_group = counts.groupBy("source", "role_group", "row").agg(F.sort_array(F.collect_list(F.struct("test", "n"))).alias("found"))
    alike = in_group.groupBy("source", "found").agg(F.count(F.lit(1)).alias("times"))
    per_source = alike.groupBy("source").agg(F.collect_list(F.struct(F.map_from_entries("found").alias("found"), "times")).alias("alike"))
    out = domains.groupBy(F.col("code").alias("source")).agg(F.collect_set("domain").alias("domains")).join(per_source, "source", "left")
    if programs.filter(F.exists(F.map_values("groups"), lambda g: g["alone"])).isEmpty():
        out = out.withColumn("all_groups", F.lit(0).cast("long"))
    else:
        every = attributes.groupBy("source").agg((F.count_distinct(F.when(F.col("role_group") != 0, F.col("role_group"))) + F.count_if(F.col("role_group") == 0)).alias("all_groups"))
        out = out.join(every, "source", "left")
    matched = F.array_distinct(F.flatten(F.transform("alike", lambda x: F.map_keys(x["found"]))))
    out = out.withColumn("_matched", F.concat(F.coalesce(matched, F.array().cast("array<bigint>")), F.array(F.lit(-1).cast("long"))))
    asked = programs.join(focus.groupBy("constraint_id").agg(F.collect_set("domain").alias("_in")), "constraint_id").withColumn("_test", F.explode("needs"))
    met = out.withColumn("_test", F.explode("_matched")).join(small(asked, BROADCAST_ROWS // 10), "_test")
    met = met.filter(F.arrays_overlap("domains", "_in") & (F.get(F.filter("needs", lambda x: F.array_contains("_matched", x)), F.lit(0)) == F.col("_test")))  # once, of several that match

    def total(n: Callable[[Column], Column]) -> Column:
        """The sum of n over the source's role groups."""
        return F.coalesce(F.aggregate("alike", F.lit(0).cast("long"), lambda a, x: a + n(x) * x["times"]), F.lit(0).cast("long"))

    def number(t: Column) -> Column:
        group = F.try_element_at("groups", t["arg"])
        may = lambda x: group["need"].isNull() | F.arrays_overlap(group["need"]["tests"], F.map_keys(x["found"]))  # noqa: E731  most role groups have none of the needed tests
        fits = lambda x: F.when(may(x), holds(group["program"], _of(x["found"]))).otherwise(F.lit(False))
        rest = F.coalesce("all_groups", F.lit(0)) - total(lambda x: (~fits(x)).cast("long"))  # of a group that holds alone
        by_group = F.when(group.isNull(), F.lit(0).cast("long")).when(group["alone"], rest).otherwise(total(lambda x: fits(x).cast("long")))
        return F.when(t["op"] == "group", by_group).otherwise(total(lambda x: _of(x["found"])(t)))

    return met.filter(holds(F.col("program"), number)).select("constraint_id", F.col("source").alias("code"))
