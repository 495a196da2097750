"""Value sets: compose rules as rows, evaluated for all value sets of a table at once.

rules: url, side (include / exclude), rule_no, system, system_version, and per row either a listed
concept (concept_no, code, display), a filter (filter_no, property, op, value) or a reference
(ref_url); a row with none of these means the whole system. An expansion has url, system, code,
display, place.

tables hold all systems together: concepts (system, code, display, active, abstract, module),
edges and closure (with system), properties (system, code, property, value_text), members, systems
(system, version, case_sensitive, content).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.functions.versions import version_key
from termloom.operators import hierarchy as H
from termloom.operators.codes import current, keys_of, with_own
from termloom.operators.search import inverted_index, prefix_search
from termloom.tables import BROADCAST_ROWS, cut

RULES = (
    "url string, side string, rule_no int, system string, system_version string, concept_no int, code string, display string, "
    "filter_no int, property string, op string, value string, ref_url string"
)
_RULE = ["url", "side", "rule_no"]
TREE_OPS = ("is-a", "descendent-of", "is-not-a", "generalizes", "child-of", "descendent-leaf")


@dataclass(frozen=True)
class SystemTables:
    """The tables of all systems. closure may be a function that gives it: then rules walk the edges from the codes that they name, and it is called only where too many levels lie below these.

    sets (value, system, code) are the sets that `constraint` filters name (see named_sets);
    designations (code, term, active, perhaps system; those of supplements too) take part in text filters, through
    index, where it has been built before (text_index); only (system, code) narrows every rule to these codes.
    """

    concepts: DataFrame
    edges: DataFrame
    closure: DataFrame | Callable[[], DataFrame]
    properties: DataFrame
    systems: DataFrame
    members: DataFrame | None = None
    sets: DataFrame | None = None
    designations: DataFrame | None = None
    only: DataFrame | None = None
    index: DataFrame | None = None

    @property
    def reach(self) -> DataFrame:
        return self.closure() if callable(self.closure) else self.closure

    def narrowed(self, df: DataFrame) -> DataFrame:
        """Rows of df (system, code) that rules may give."""
        return df if self.only is None else df.join(self.only, ["system", "code"], "left_semi")

    @property
    def codes(self) -> DataFrame:
        return self.narrowed(self.concepts.select("system", "code"))


def named_sets(sets: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """SystemTables.sets from name -> (system, DataFrame[code]), as the set operators of concepts give them."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("value"), F.lit(system).alias("system"), "code") for name, (system, df) in sets.items()])


def rule(url: str, side: str, no: int, system: str | None, codes: list | None = None, filters: list | None = None, refs: list | None = None, version: str | None = None) -> list[tuple]:
    """The rows of one rule: codes are strings or (code, display), filters (property, op, value), refs urls."""
    head, out = (url, side, no, system, version), []
    for i, c in enumerate(codes or []):
        c = c if isinstance(c, tuple) else (c, None)
        out.append((*head, i, *c, None, None, None, None, None))
    for i, f in enumerate(filters or []):
        out.append((*head, None, None, None, i, *f, None))
    for r in refs or []:
        out.append((*head, None, None, None, None, None, None, None, r))
    return out or [(*head, None, None, None, None, None, None, None, None)]


# Conditions that give codes: (rule key, cond, system, code, place, label), a row perhaps more than
# once. What is negative, or a pattern, gives none: it is tested on the codes that a rule's other
# conditions leave, or on its whole system where there are no others.


def _keyed(df: DataFrame, cond: Column, place: Column | None = None, label: Column | None = None) -> DataFrame:
    return df.select(*_RULE, *[c for c in df.columns if c == "_n"], cond.alias("cond"), "system", "code", (F.lit(None) if place is None else place).cast("int").alias("place"), (F.lit(None) if label is None else label).cast("string").alias("label"))


def enumerated(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Listed concepts that exist, in the system's own spelling; unknown ones are dropped. Only concepts that are listed in some case are keyed.

    Lists of more than BROADCAST_ROWS meet concepts by shuffle, however small they are when compressed, and never pass the driver.
    """
    rows = rules.filter("code IS NOT NULL")
    many = rows.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
    named = rows.select("system", F.lower("code").alias("_low")).distinct()
    named = named.hint("merge") if many else named
    concepts = t.concepts.select("system", "code", F.lower("code").alias("_low")).join(named, ["system", "_low"], "left_semi")
    listed = with_own(rows, concepts, t.systems, by_shuffle=many).filter("_own IS NOT NULL")
    return t.narrowed(_keyed(listed.withColumn("code", F.col("_own.code")), F.lit("listed"), F.col("concept_no"), F.col("display")))


def _filters(rules: DataFrame) -> DataFrame:
    return rules.filter("filter_no IS NOT NULL").select(*_RULE, *[c for c in rules.columns if c == "_n"], "system", "filter_no", "property", "op", "value").withColumn("_cond", F.concat(F.lit("f"), "filter_no"))


def _kind() -> Column:
    """What a row of a rule is: listed, ref, all, a tree operator, or the kind of another filter."""
    op, named = F.col("op"), F.col("property").isin("concept", "code")
    return (
        F.when(F.col("code").isNotNull(), "listed").when(F.col("ref_url").isNotNull(), "ref").when(F.col("filter_no").isNull(), "all")
        .when(op.isin(*TREE_OPS), op).when(op == "in-refset", "refset").when(op == "is-refset", "refsets").when(F.col("property") == "constraint", "constraint")
        .when(F.col("property").isin("parent", "child"), F.col("property"))
        .when(named & op.isin("=", "in"), "codes").when(named, "code-test")
        .when(op.isin("=", "in") | ((op == "exists") & (F.col("value") != "false")), "property").when(op == "regex", "property-regex").otherwise("property-not")
    )


#: Kinds that are tested on the codes that the others give.
TESTS = ("is-not-a", "code-test", "property-regex", "property-not", "all")


def _listed(f: DataFrame) -> DataFrame:
    """Filters of = and in, one row a value."""
    values = F.when(F.col("op") == "in", F.transform(F.split("value", ","), lambda x: F.trim(x))).otherwise(F.array("value"))
    return f.withColumn("_value", F.explode(F.array_distinct(values)))


def tree_filters(rules: DataFrame, t: SystemTables, kinds: set[str]) -> DataFrame:
    """is-a, descendent-of, generalizes, child-of, descendent-leaf on the concept, and parent / child of one hop."""
    f, on, op = _filters(rules), ["system", "value"], F.col("op")
    child = t.edges.select("system", F.col("child").alias("code"), F.col("parent").alias("value"))
    parent = t.edges.select("system", F.col("parent").alias("code"), F.col("child").alias("value"))
    down = _reach(f.filter(op.isin("is-a", "descendent-of", "descendent-leaf")), t) if kinds & {"is-a", "descendent-of", "descendent-leaf"} else None
    branches: list[tuple[set[str], Column, Callable[[], DataFrame]]] = [
        ({"is-a", "descendent-of"}, op.isin("is-a", "descendent-of"), lambda: down),
        ({"generalizes"}, op == "generalizes", lambda: _reach(f.filter("op = 'generalizes'"), t, up=True)),
        ({"child-of", "parent"}, (op == "child-of") | ((F.col("property") == "parent") & (op == "=")), lambda: child),
        ({"child"}, (F.col("property") == "child") & (op == "="), lambda: parent),
        ({"descendent-leaf"}, op == "descendent-leaf", lambda: down.join(parent.select("system", "code").distinct(), ["system", "code"], "left_anti")),
    ]
    used = [_keyed(f.filter(test).join(t.narrowed(other()), on), F.col("_cond")) for own, test, other in branches if own & kinds]
    if kinds & {"is-a", "generalizes"}:  # the named codes themselves: only they meet the concepts
        own = f.filter(op.isin("is-a", "generalizes")).withColumn("code", F.col("value"))
        used.append(_keyed(t.narrowed(own.join(t.concepts.select("system", "code"), ["system", "code"], "left_semi")), F.col("_cond")))
    return reduce(DataFrame.unionByName, used)


def _reach(f: DataFrame, t: SystemTables, up: bool = False) -> DataFrame:
    """(system, value, code): what lies below (or above) the values of filters: by a walk from these, or from the closure where that has been built, or many levels lie there."""
    at, to = ("descendant", "ancestor") if up else ("ancestor", "descendant")
    walked = H.reached(f.select("system", F.col("value").alias("code")), t.edges, up) if callable(t.closure) else None
    if walked is not None:
        return walked.select("system", F.col("start").alias("value"), "code")
    return t.reach.select("system", F.col(to).alias("code"), F.col(at).alias("value"))


def code_filters(rules: DataFrame, t: SystemTables) -> DataFrame:
    """= and in on the concept's code."""
    f = _listed(_filters(rules).filter(F.col("property").isin("concept", "code") & F.col("op").isin("=", "in"))).withColumnRenamed("_value", "code")
    return _keyed(f.join(t.codes, ["system", "code"]), F.col("_cond"))


def property_filters(rules: DataFrame, t: SystemTables) -> DataFrame:
    """=, in and exists=true on a declared property."""
    f = _filters(rules).filter(~F.col("property").isin("concept", "code", "parent", "child", "constraint"))
    held = t.narrowed(t.properties.select("system", "code", "property", F.col("value_text").alias("_value")))
    equal = _keyed(_listed(f.filter(F.col("op").isin("=", "in"))).join(held, ["system", "property", "_value"]), F.col("_cond"))
    there = f.filter((F.col("op") == "exists") & (F.col("value") != "false")).join(held.select("system", "property", "code").distinct(), ["system", "property"])
    return equal.unionByName(_keyed(there, F.col("_cond")))


def refset_filters(rules: DataFrame, t: SystemTables) -> DataFrame:
    """concept in <reference set>: op `in-refset`."""
    f = _filters(rules).filter("op = 'in-refset'")
    held = t.narrowed(t.members.filter("active").select("system", "code", F.col("refset_id").alias("value")))
    return _keyed(f.join(held, ["system", "value"]), F.col("_cond"))


def all_refsets(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Concepts that are reference sets with members: op `is-refset`."""
    sets = t.members.select("system", F.col("refset_id").alias("code")).distinct()
    return _keyed(_filters(rules).filter("op = 'is-refset'").join(t.codes.join(sets, ["system", "code"], "left_semi"), "system"), F.col("_cond"))


def constraint_filters(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Codes of a set given by the set operators: property `constraint`, whose value names one of t.sets; an unknown name is an error."""
    f = _filters(rules).filter("property = 'constraint'")
    if t.sets is None:
        raise ValueError("a constraint filter needs the tables' sets")
    lost = f.select("value").distinct().join(t.sets.select("value"), "value", "left_anti").first()
    if lost:
        raise ValueError(f"no set, or none with a code, is named {lost['value']}")
    return _keyed(f.join(t.narrowed(t.sets), ["system", "value"]).join(t.codes, ["system", "code"], "left_semi"), F.col("_cond"))


def _fits(test: Column) -> Column:
    """Whether the column code passes a pattern or negative test (op, value) of the code."""
    listed = F.transform(F.split(test["value"], ","), lambda x: F.trim(x))
    pattern = F.rlike(F.col("code"), F.concat(F.lit("^(?:"), test["value"], F.lit(")$")))
    return F.when(test["op"] == "regex", pattern).when(test["op"] == "not-in", ~F.array_contains(listed, F.col("code"))).otherwise(test["value"] == "true")


def _without_tested(kept: DataFrame, rules: DataFrame) -> DataFrame:
    """kept (url, system, code, ...) less what excludes of tests of the code alone (or of nothing: the whole system) take out, row by row."""
    tests = rules.groupBy(*_RULE).agg(F.max("system").alias("system"), F.collect_list(F.when(F.col("filter_no").isNotNull(), F.struct("op", "value"))).alias("_tests"))
    outs = tests.groupBy("url", "system").agg(F.collect_list("_tests").alias("_outs"))
    gone = F.exists("_outs", lambda tests: F.forall(tests, lambda x: F.coalesce(_fits(x), F.lit(False))))
    return kept.join(outs, ["url", "system"], "left").filter(F.col("_outs").isNull() | ~gone).drop("_outs")


def _tested(base: DataFrame, rules: DataFrame, t: SystemTables, kinds: set[str]) -> DataFrame:
    """base (rule key, system, code, ...) less the codes that fail a negative filter or a pattern of their rule."""
    f, key = _filters(rules), [*_RULE, "system", "code"]
    of = lambda kind: _filters(rules.filter(_kind() == kind)).drop("system")
    if "code-test" in kinds:
        tests = of("code-test").groupBy(*_RULE).agg(F.collect_list(F.struct("op", "value")).alias("_tests"))
        base = base.join(tests, _RULE, "left").filter(F.col("_tests").isNull() | F.forall("_tests", _fits)).drop("_tests")
    if "is-not-a" in kinds:
        nots = f.filter("op = 'is-not-a'")
        inside = nots.join(t.narrowed(_reach(nots, t)), ["system", "value"]).select(key).unionByName(nots.withColumn("code", F.col("value")).select(key))
        base = base.join(inside, key, "left_anti")
    held = t.properties.select("system", "code", "property", "value_text")
    if "property-not" in kinds:
        listed = F.transform(F.split("value", ","), lambda x: F.trim(x))
        met = base.select(key).join(of("property-not"), _RULE).join(held, ["system", "code", "property"])
        base = base.join(met.filter((F.col("op") == "exists") | F.array_contains(listed, F.col("value_text"))).select(key), key, "left_anti")
    if "property-regex" in kinds:
        rules_n = of("property-regex").groupBy(*_RULE).agg(F.count(F.lit(1)).alias("_n"))
        met = base.select(key).join(of("property-regex"), _RULE).join(held, ["system", "code", "property"]).filter(F.rlike(F.col("value_text"), F.concat(F.lit("^(?:"), F.col("value"), F.lit(")$"))))
        counts = met.groupBy(*key).agg(F.count_distinct("_cond").alias("_met"))
        base = base.join(rules_n, _RULE, "left").join(counts, key, "left").filter("_n IS NULL OR _n = _met").drop("_n", "_met")
    return base


def undeclared(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Filters on a property that the system does not declare, or on an unknown code: url, rule_no, filter_no, reason."""
    f = _filters(rules)
    fixed = F.col("property").isin("concept", "code", "parent", "child")
    props = f.filter(~fixed).join(t.properties.select("system", "property").distinct(), ["system", "property"], "left_anti").withColumn("reason", F.lit("property"))
    named = f.filter(fixed & (F.col("op").isin(*TREE_OPS) | (F.col("op") == "=")))
    codes = named.join(t.concepts.select("system", F.col("code").alias("value")), ["system", "value"], "left_anti").withColumn("reason", F.lit("code"))
    return props.select(*_RULE, "filter_no", "reason").unionByName(codes.select(*_RULE, "filter_no", "reason"))


#: Operators that are known: on the code, on a property, and those of implicit value sets.
CODE_OPS = (*TREE_OPS, "=", "in", "not-in", "regex", "exists")
PROPERTY_OPS = ("=", "in", "not-in", "regex", "exists")
OWN_OPS = ("in-refset", "is-refset")


def refused(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Filters that are refused, rather than read as something else or answered with nothing: url, side, rule_no, filter_no, property, op, value, reason.

    unknown-operator; unsupported-operator (one that the property does not take: parent and child take `=` alone, declared
    properties no tree operators); bad-value (`exists` with neither true nor false); undeclared-property; unknown-code (of
    those that tree operators, `=`, `in` and `not-in` name). The properties of a system are those that its tables hold.
    """
    f = _filters(rules)
    op, prop, on_code = F.col("op"), F.col("property"), F.col("property").isin("concept", "code")
    hop, constraint, own = prop.isin("parent", "child"), prop == "constraint", op.isin(*OWN_OPS)
    known = op.isin(*CODE_OPS, *OWN_OPS)
    unsupported = F.when(on_code | own, F.lit(False)).when(hop | constraint, op != "=").otherwise(~op.isin(*PROPERTY_OPS))
    shape = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown-operator").when(unsupported, "unsupported-operator")
        .when((op == "exists") & ~F.coalesce(F.trim("value").isin("true", "false"), F.lit(False)), "bad-value")
    )
    columns = [*_RULE, "filter_no", "property", "op", "value", "reason"]
    misshapen = f.withColumn("reason", shape).filter("reason IS NOT NULL").select(columns)
    sound = f.withColumn("_shape", shape).filter("_shape IS NULL")
    declared = t.properties.select("system", "property").distinct()
    props = sound.filter(~(on_code | hop | constraint | own)).join(declared, ["system", "property"], "left_anti").withColumn("reason", F.lit("undeclared-property")).select(columns)
    values = F.when(op.isin("in", "not-in"), F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array("value"))
    named = sound.filter((on_code & op.isin(*TREE_OPS, "=", "in", "not-in")) | hop).withColumn("_value", F.explode(values))
    wanted = named.select("system", F.lower("_value").alias("_low")).distinct()
    there = t.concepts.select("system", "code", F.lower("code").alias("_low")).join(wanted, ["system", "_low"], "left_semi").select("system", "code")
    codes = named.join(there.withColumnRenamed("code", "_value"), ["system", "_value"], "left_anti").withColumn("reason", F.lit("unknown-code")).select(columns).distinct()
    return misshapen.unionByName(props).unionByName(codes)


def _counted(rules: DataFrame) -> DataFrame:
    """rules with _n, the number of conditions of their rule that give codes."""
    conds = F.when(F.col("code").isNotNull(), "listed").when(F.col("filter_no").isNotNull(), F.concat(F.lit("f"), "filter_no")).when(F.col("ref_url").isNotNull(), F.concat(F.lit("r"), "ref_url"))
    return rules.join(rules.groupBy(*_RULE).agg(F.count_distinct(F.when(~_kind().isin(*TESTS), conds)).cast("int").alias("_n")), _RULE)


def _met(rules: DataFrame, t: SystemTables, known: DataFrame | None, kinds: set[str], whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(rule key, system, code, place, label) of the codes that meet all conditions of a rule; whole gives those that rules (rule key, system) without a condition that gives codes start from.

    Rules know the number of their conditions (see _counted). What these give moves once, to the tasks
    of (url, system, code), where conditions are counted and rules united.
    """
    ways = {
        "listed": lambda: enumerated(rules, t), "codes": lambda: code_filters(rules, t), "property": lambda: property_filters(rules, t), "refset": lambda: refset_filters(rules, t),
        "refsets": lambda: all_refsets(rules, t), "constraint": lambda: constraint_filters(rules, t),
    }
    parts = [way() for kind, way in ways.items() if kind in kinds]
    tree = kinds & {*TREE_OPS, "parent", "child"} - {"is-not-a"}
    if tree:
        parts.append(tree_filters(rules, t, tree))
    if known is not None and "ref" in kinds:
        refs = rules.filter("ref_url IS NOT NULL").select(*_RULE, "_n", F.col("system").alias("_only"), "ref_url")
        held = refs.join(known.select(F.col("url").alias("ref_url"), "system", "code"), "ref_url").filter("_only IS NULL OR _only = system")
        parts.append(_keyed(held, F.concat(F.lit("r"), "ref_url")))
    base = []
    if parts:
        together = reduce(DataFrame.unionByName, parts).repartition("url", "system", "code")
        met = together.groupBy(*_RULE, "_n", "system", "code").agg(F.count_distinct("cond").alias("_met"), F.min("place").alias("place"), F.max("label").alias("label"))
        base.append(met.filter("_met = _n").drop("_met", "_n"))
    if kinds & set(TESTS) or not parts:
        base.append(_keyed(whole(rules.filter("_n = 0").groupBy(*_RULE).agg(F.max("system").alias("system"))), F.lit("all")).drop("cond"))
    return _tested(reduce(DataFrame.unionByName, base), rules.drop("_n"), t, kinds)


def _evaluate(rules: DataFrame, t: SystemTables, known: DataFrame | None, kinds: dict[str, set[str]]) -> DataFrame:
    """Expansions of the urls in rules, whose references are all in known (url, system, code); kinds of a side that no rule has only cost planning."""
    met = _met(rules.filter("side = 'include'"), t, known, kinds["include"], lambda whole: whole.join(t.codes, "system"))
    first = F.min(F.struct("rule_no", F.coalesce("place", F.lit(0)).alias("place"), "label"))
    kept = met.groupBy("url", "system", "code").agg(first.alias("_first"))
    if kinds["exclude"] and kinds["exclude"] <= {"code-test", "all"}:
        kept = _without_tested(kept, rules.filter("side = 'exclude'"))
    elif kinds["exclude"]:
        kept = cut(kept, "included")  # what is not included need not be excluded
        out = _met(rules.filter("side = 'exclude'"), t, known, kinds["exclude"], lambda whole: whole.join(kept.select("url", "system", "code"), ["url", "system"]))
        kept = kept.join(out.select("url", "system", "code").hint("merge"), ["url", "system", "code"], "left_anti")  # as many as excludes give: not for the driver
    return kept.select("url", "system", "code", F.col("_first.rule_no").alias("rule_no"), F.col("_first.place").alias("concept_no"), F.col("_first.label").alias("label"))


def _kinds(rules: DataFrame) -> dict[str, set[str]]:
    """The kinds of rows that each side has: a few words, whatever the rules, so that plans hold no branch without rows."""
    found: dict[str, set[str]] = {"include": set(), "exclude": set()}
    for side, kind in rules.select("side", _kind()).distinct().collect():
        found[side].add(kind)
    return found


def _with_references(rules: DataFrame, t: SystemTables) -> DataFrame:
    """Expansions of rules that refer to each other.

    A value set is plain if it excludes nothing and each of its references stands alone in an include: what
    it refers to is then only united, however long the chain. The rules of plain sets without references are evaluated once,
    and each plain set takes what lies at the end of its ways through plain sets. The others (an exclude or an
    intersection ends a stratum) are evaluated stratum by stratum, all at once whose references are known by then.
    """
    shape = rules.groupBy(*_RULE).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ref_url").isNotNull()).alias("refers"), F.max("system").alias("system"))
    mixed = (F.col("side") == "exclude") | (F.col("refers") & ((F.col("n") > 1) | F.col("system").isNotNull()))
    urls = cut(shape.groupBy("url").agg((~F.max(mixed)).alias("plain")), "value-sets")
    strict, plain = urls.filter("NOT plain").select("url"), urls.filter("plain").select("url")
    refs = cut(rules.filter("ref_url IS NOT NULL").select("url", "rule_no", "ref_url").distinct().join(urls, "url"), "references")
    reach, united = urls.select(F.col("url").alias("ref_url"), F.col("url").alias("end")), not refs.filter("plain").isEmpty()  # what a reference draws on
    if united:
        ways = H.transitive_closure(refs.filter("plain").select(F.col("url").alias("child"), F.col("ref_url").alias("parent"))).select(F.col("descendant").alias("ref_url"), F.col("ancestor").alias("end"))
        loops = ways.join(ways.select(F.col("end").alias("ref_url"), F.col("ref_url").alias("end")), ["ref_url", "end"]).select("ref_url").unionByName(refs.filter("url = ref_url").select("ref_url"))
        if not loops.isEmpty():
            raise ValueError("value sets refer to each other in a circle")
        reach = ways.unionByName(reach)
    own = rules.join(plain, "url", "left_semi").filter("ref_url IS NULL")
    kinds = _kinds(own)
    base = cut(_evaluate(own, t, None, kinds), "expansion") if any(kinds.values()) else None
    done, left, size = base, strict, strict.count()
    while size:
        waiting = refs.join(left, "url", "left_semi").join(reach, "ref_url").join(left.select(F.col("url").alias("end")), "end", "left_semi").select("url").distinct()
        waiting = cut(waiting, "stratum")
        before, size = size, waiting.count()
        if size == before:
            raise ValueError("value sets refer to each other in a circle")
        now = rules.join(left.join(waiting, "url", "left_anti") if size else left, "url", "left_semi")
        needed = now.filter("ref_url IS NOT NULL").select("ref_url").distinct().join(reach, "ref_url")
        known = needed.join(done.select(F.col("url").alias("end"), "system", "code"), "end").select(F.col("ref_url").alias("url"), "system", "code") if done is not None else None  # a code perhaps more than once
        made = cut(_evaluate(now, t, known, _kinds(now)), "expansion")
        done, left = made if done is None else done.unionByName(made), waiting
    if done is None or not united:
        return done
    drawn = refs.filter("plain").select("url", "rule_no", "ref_url").join(reach, "ref_url").join(done.select(F.col("url").alias("end"), "system", "code"), "end")
    drawn = drawn.select("url", "system", "code", "rule_no", F.lit(0).alias("concept_no"), F.lit(None).cast("string").alias("label"))
    first = F.min(F.struct("rule_no", "concept_no", "label"))
    return done.unionByName(drawn).groupBy("url", "system", "code").agg(first.alias("_first")).select("url", "system", "code", "_first.*")


def reference_cycles(rules: DataFrame) -> DataFrame:
    """Value sets that reach themselves through references, or refer to one that does."""
    refs = rules.filter("ref_url IS NOT NULL").select(F.col("url").alias("parent"), F.col("ref_url").alias("child")).distinct()
    return H.detect_cycles(refs.select(F.col("parent").alias("child"), F.col("child").alias("parent"))).select(F.col("node").alias("url"))


def expand(rules: DataFrame, t: SystemTables, active_only: bool = False, selectable_only: bool = False, text: str | DataFrame | None = None, refuse: bool = True) -> DataFrame:
    """url, system, code, display, inactive, rule_no, concept_no of every value set in rules.

    Rules inside an include intersect, includes unite (the first keeps its place), excludes go.
    References are resolved from the ones below up; a circle of references is an error, and so is a filter that is
    refused (see `refused`), unless refuse is false: then the rules that have one give nothing. text, one for all or
    a table (url, text), keeps the codes of which the display, or an active designation where the tables have
    them, has all its words. Texts meet the tables' word index, not terms one by one.
    """
    rules, out = _contents(rules, t, refuse)
    concepts = t.concepts.select("system", "code", "display", "active", "abstract")
    many = rules.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS  # so many rules mostly list codes: their expansion is as large
    out = out.join(concepts.hint("merge") if many else concepts, ["system", "code"])
    if active_only:
        out = out.filter("active")
    if selectable_only:
        out = out.filter("NOT abstract")
    if text is not None:
        texts = out.select("url").distinct().withColumn("text", F.lit(text)) if isinstance(text, str) else text
        wordy = texts.select(F.col("url").alias("query_id"), "text").filter(F.size(tokens(F.col("text"))) > 0)
        found = prefix_search(wordy, text_index(t) if t.index is None else t.index, "key").select(F.col("query_id").alias("url"), "key.system", "key.code").distinct().withColumn("_named", F.lit(True))
        asked = wordy.select(F.col("query_id").alias("url"), F.lit(True).alias("_asked")).distinct()
        out = out.join(found, ["url", "system", "code"], "left").join(asked, "url", "left").filter("_asked IS NULL OR _named").drop("_named", "_asked")
    return out.select("url", "system", "code", F.coalesce("label", "display").alias("display"), (~F.col("active")).alias("inactive"), "rule_no", "concept_no")


def _contents(rules: DataFrame, t: SystemTables, refuse: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rules that take part, and what they give: url, system, code, rule_no, concept_no, label; codes are not yet held against the concepts."""
    rules = cut(_counted(rules), "rules")
    kinds = _kinds(rules)
    if (kinds["include"] | kinds["exclude"]) - {"listed", "ref", "all"}:
        bad = refused(rules, t)
        if refuse:
            first = bad.orderBy("url", "rule_no", "filter_no").first()
            if first:
                raise ValueError(f"{first['url']}: {first['reason']}: {first['property']} {first['op']} {first['value']}")
        else:
            rules = cut(rules.join(bad.filter("reason != 'unknown-code' OR NOT op IN ('in', 'not-in')").select(*_RULE).distinct(), _RULE, "left_anti"), "rules-sound")
            kinds = _kinds(rules)
    return rules, _with_references(rules, t) if "ref" in kinds["include"] | kinds["exclude"] else _evaluate(rules, t, None, kinds)


def text_index(t: SystemTables) -> DataFrame:
    """(word, key): the words of displays and active designations; key is the term's system, code and id. Written sorted by word (search.write_index), a prefix reads few row groups of it."""
    rows = t.concepts.select("system", "code", F.lit(None).cast("string").alias("id"), F.col("display").alias("term"))
    if t.designations is not None:
        d = t.designations.filter("active")
        named = d if "system" in d.columns else d.join(t.concepts.select("system", "code"), "code")
        rows = rows.unionByName(named.select("system", "code", (F.col("designation_id") if "designation_id" in d.columns else F.col("term")).cast("string").alias("id"), "term"))
    return inverted_index(t.narrowed(rows).withColumn("key", F.struct("system", "code", "id")), "key")


def pages(expansion: DataFrame, offset: int, count: int) -> DataFrame:
    """The same page of every value set, in the order of its compose, with place and total; each task keeps the first ones of a value set only."""
    expansion = cut(expansion, "paged")  # read for the page and for the totals
    order = Window.partitionBy("url").orderBy("rule_no", "concept_no", "system", "code")
    first = expansion.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= offset + count)
    placed = first.withColumn("place", F.col("_row") - 1).filter(F.col("place") >= offset).drop("_row")
    return placed.join(expansion.groupBy("url").agg(F.count(F.lit(1)).alias("total")), "url")


def _drawn_on(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) and all that they refer to."""
    refs = rules.filter("ref_url IS NOT NULL").select(F.col("url").alias("child"), F.col("ref_url").alias("parent"))
    if refs.isEmpty():
        return urls
    return urls.unionByName(H.ancestors(urls.select(F.col("url").alias("code")), H.transitive_closure(refs)).select(F.col("code").alias("url"))).distinct()


def holding(codes: DataFrame, urls: DataFrame, rules: DataFrame, t: SystemTables) -> DataFrame:
    """(url, system, code): which of codes (system, code) the value sets urls hold. Concepts nobody asks about never meet a rule; codes of case-blind systems are found in any case."""
    own = cut(with_own(codes.select("system", "code").distinct(), t.concepts, t.systems).filter("_own IS NOT NULL").select("system", "code", F.col("_own.code").alias("_code")), "asked-codes")
    narrow = replace(t, only=own.select("system", F.col("_code").alias("code")).distinct())
    urls = urls.select("url").distinct()
    _, held = _contents(rules.join(_drawn_on(urls, rules), "url", "left_semi"), narrow)  # of codes that are concepts
    held = held.join(urls, "url", "left_semi").select("url", "system", F.col("code").alias("_code"))
    return held.join(own, ["system", "_code"]).select("url", "system", "code")


def contains(asked: DataFrame, rules: DataFrame, t: SystemTables) -> DataFrame:
    """asked (url, system, code) with `inside`: concepts nobody asks about never meet a rule. Codes of case-blind systems are found in any case."""
    found = holding(asked, asked, rules, t).withColumn("_in", F.lit(True))
    return asked.join(found, ["url", "system", "code"], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def check_rules(rules: DataFrame) -> DataFrame:
    """(url, side, rule_no, error): vsd-1 neither system nor reference; vsd-2 concepts or filters without a system; vsd-3 both of them."""
    shape = rules.groupBy(*_RULE).agg(
        F.max("system").alias("system"), F.max(F.col("ref_url").isNotNull()).alias("refs"), F.max(F.col("code").isNotNull()).alias("codes"), F.max(F.col("filter_no").isNotNull()).alias("filters")
    )
    tests = {"vsd-1": F.col("system").isNull() & ~F.col("refs"), "vsd-2": F.col("system").isNull() & (F.col("codes") | F.col("filters")), "vsd-3": F.col("codes") & F.col("filters")}
    errors = F.filter(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()]), lambda e: e.isNotNull())
    return shape.select(*_RULE, F.explode(errors).alias("error"))


def with_designations(expansion: DataFrame, designations: DataFrame, languages: list[str] | None = None, uses: list[str] | None = None) -> DataFrame:
    chosen = designations.filter("active")
    chosen = chosen.filter(F.col("language").isin(languages)) if languages else chosen
    chosen = chosen.filter(F.col("use_code").isin(uses)) if uses else chosen
    on = keys_of(chosen, expansion)
    lists = chosen.join(expansion.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("language", "use_code", "term"))).alias("designations"))
    return expansion.join(lists, on, "left")


def with_properties(expansion: DataFrame, properties: DataFrame, names: list[str]) -> DataFrame:
    """Chosen properties as a map; inactive rows always carry status."""
    lists = properties.filter(F.col("property").isin(names)).groupBy("system", "code").agg(F.sort_array(F.collect_list(F.struct("property", "value_text"))).alias("_p"))
    own = F.coalesce("_p", F.array().cast("array<struct<property:string,value_text:string>>"))
    status = F.when(F.col("inactive"), F.array(F.struct(F.lit("status").alias("property"), F.lit("inactive").alias("value_text")))).otherwise(F.array().cast("array<struct<property:string,value_text:string>>"))
    return expansion.join(lists, ["system", "code"], "left").withColumn("properties", F.map_from_entries(F.concat(own, status))).drop("_p")


def used_versions(rules: DataFrame, systems: DataFrame, supplements: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """url, kind, used: what each value set draws on, itself and through references.

    Kinds are system (url and version; the one that a rule names, else the greatest), fragment (the same again where that version's content is
    a fragment), value-set, and supplement: those of supplements (system, supplement_url, version) that asked (url, supplement_url) asks for
    of a system that is drawn on.
    """
    refs = rules.filter("ref_url IS NOT NULL").select(F.col("url").alias("child"), F.col("ref_url").alias("parent")).distinct()
    reach = H.transitive_closure(refs).select(F.col("descendant").alias("url"), F.col("ancestor").alias("via"))
    own = rules.select("url", F.col("url").alias("via")).distinct().unionByName(reach)
    newest = current(systems.select("system", "version")).select("system", F.col("version").alias("_newest"))
    named = rules.filter("system IS NOT NULL").select(F.col("url").alias("via"), "system", "system_version").distinct().join(newest, "system")
    drawn = cut(own.join(named, "via").select("url", "system", F.coalesce("system_version", "_newest").alias("version")).distinct(), "systems-drawn")
    canonical = F.concat_ws("|", "system", "version").alias("used")
    out = drawn.select("url", F.lit("system").alias("kind"), canonical).unionByName(reach.select("url", F.lit("value-set").alias("kind"), F.col("via").alias("used")))
    if "content" in systems.columns:
        partial = systems.filter("content = 'fragment'").select("system", "version")
        out = out.unionByName(drawn.join(partial, ["system", "version"]).select("url", F.lit("fragment").alias("kind"), canonical))
    if supplements is not None and asked is not None:
        wanted = own.join(asked.select(F.col("url").alias("via"), "supplement_url"), "via").select("url", "supplement_url").distinct()
        held = wanted.join(supplements.select("system", "supplement_url", F.col("version").alias("_version")), "supplement_url").join(drawn.select("url", "system").distinct(), ["url", "system"])
        out = out.unionByName(held.select("url", F.lit("supplement").alias("kind"), F.concat_ws("|", "supplement_url", "_version").alias("used")).distinct())
    return out


#: What a value set or a system may state on a concept, to be echoed in expansions.
ECHOES = ("label", "concept_order", "style", "xhtml", "definition")


def with_echoes(expansion: DataFrame, stated: DataFrame, defined: DataFrame, definitions: bool = False) -> DataFrame:
    """expansion with label, concept_order, style, xhtml and definition: what its value set states (url, system, code, ...), else what its system does (system, code, ...).

    Each is taken on its own; columns that either table lacks count as null. definition comes only where it is asked for.
    """
    names = [e for e in ECHOES if definitions or e != "definition"]
    pick = lambda df, keys, p: df.select(*keys, *[(F.col(e) if e in df.columns else F.lit(None)).cast("int" if e == "concept_order" else "string").alias(f"{p}{e}") for e in names])
    out = expansion.drop(*ECHOES).join(pick(stated, ["url", "system", "code"], "_own_"), ["url", "system", "code"], "left").join(pick(defined, ["system", "code"], "_def_"), ["system", "code"], "left")
    out = out.withColumns({e: F.coalesce(f"_own_{e}", f"_def_{e}") for e in names})
    return out.drop(*[f"_{p}_{e}" for p in ("own", "def") for e in names])


def pin_versions(rules: DataFrame, pins: DataFrame, systems: DataFrame, set_pins: DataFrame | None = None, value_sets: DataFrame | None = None, exclude: list[str] | None = None) -> DataFrame:
    """rules with `resolved` and `pin_error`, without those of systems in exclude.

    pins: system, default_version, check_version, force_version; set_pins the same with url, for
    references (which may name a version after a bar); value_sets: url, version. A forced version wins
    over the named one, that over the default, that over the greatest; a result that differs from the
    checked version is an error row.
    """
    pinned = ["default_version", "check_version", "force_version"]
    rules = rules.filter(F.col("system").isNull() | ~F.col("system").isin(exclude)) if exclude else rules
    newest = greatest(systems.select(F.col("system").alias("url"), "version")).select(F.col("url").alias("system"), F.col("version").alias("_newest"))
    bar = F.split("ref_url", r"\|")
    out = rules.join(pins, "system", "left").join(newest, "system", "left").withColumn("_ref", F.get(bar, F.lit(0)))
    part = F.coalesce("force_version", "system_version", "default_version", "_newest")
    for frame, names in ((set_pins, pinned), (greatest(value_sets) if value_sets is not None else None, ["version"])):
        kind = rules.sparkSession.createDataFrame([], "_ref string, " + ", ".join(f"_{n} string" for n in names)) if frame is None else frame.select(F.col("url").alias("_ref"), *[F.col(n).alias(f"_{n}") for n in names])
        out = out.join(kind, "_ref", "left")
    by_set = F.coalesce("_force_version", F.get(bar, F.lit(1)), "_default_version", "_version")
    out = out.withColumn("resolved", F.when(F.col("ref_url").isNotNull(), by_set).when(F.col("system").isNotNull(), part))
    checked = F.when(F.col("ref_url").isNotNull(), F.col("_check_version")).otherwise(F.col("check_version"))
    return out.withColumn("pin_error", F.coalesce(F.col("resolved") != checked, F.lit(False))).drop("_newest", "_ref", "_version", *pinned, *[f"_{p}" for p in pinned])


#: Implicit value sets: kind -> the filters on a value, None for the whole system.
IMPLICIT: dict[str, Callable[[str | None], list[tuple] | None]] = {
    "all": lambda v: None,
    "subtree": lambda v: [("concept", "is-a", v)],
    "below": lambda v: [("concept", "descendent-of", v)],
    "members": lambda v: [("concept", "in-refset", v)],
    "refsets": lambda v: [("concept", "is-refset", "true")],
    "constraint": lambda v: [("constraint", "=", v)],
    "answers": lambda v: [("answers", "=", v)],
}


def implicit(kind: str, system: str, value: str | None = None, url: str | None = None) -> list[tuple]:
    """Rules of an implicit value set.

    `all` codes, the `subtree` of a code, all `below` it (as terms under a part), `members` of a reference
    set, all `refsets`, the codes of a `constraint` (a name in the tables' sets), `answers` of a list.
    """
    return rule(url or f"{system}?{kind}={value or ''}", "include", 0, system, filters=IMPLICIT[kind](value))


def fragment_flags(expansion: DataFrame, systems: DataFrame) -> DataFrame:
    """Expansion rows with `provable`: a system of content fragment, example or not-present cannot prove a code wrong."""
    return expansion.join(current(systems).select("system", (~F.col("content").isin("fragment", "example", "not-present")).alias("provable")), "system", "left")


def greatest(versions: DataFrame, key: str = "version") -> DataFrame:
    """Greatest version of each url, segment by segment; of equal ones the greatest text."""
    return versions.groupBy("url").agg(F.max_by(key, F.struct(version_key(F.col(key)), key)).alias(key))
