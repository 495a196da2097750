"""Sets of concepts: operands and results are DataFrames with one column, code, without repeats.

Tables: concepts (code, active, module, effective_time, definition_status), edges (child, parent),
closure (descendant, ancestor, min_depth), attributes (source, role_group, row_id, kind, target,
number, text), members (refset_id, code, active, effective_time, module, fields map), identifiers
(scheme, alt_code, code), designations (designation_id, code, term, language, use_code, active),
acceptability (designation_id, refset_id, acceptability).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import fold, matches_wildcard, starts_words, wildcard_regex  # noqa: F401
from termloom.operators import hierarchy as H

#: Machine epsilon of 64-bit floats: numbers closer than this are equal.
EPSILON = 2.220446049250313e-16


class UnknownConcept(ValueError):
    pass


# operands and set algebra


def self_of(concepts: DataFrame, codes: list[str], strict: bool = True) -> DataFrame:
    """The named concepts; with strict an unknown one is an error (this counts at once)."""
    found = concepts.filter(F.col("code").isin(codes)).select("code").distinct()
    if strict and found.count() < len(set(codes)):
        raise UnknownConcept(f"not all of {sorted(set(codes))[:10]} are known")
    return found


def any_of(concepts: DataFrame) -> DataFrame:
    return concepts.select("code").distinct()


def by_alternate(identifiers: DataFrame, aliases: DataFrame, alias: str, alt_code: str) -> DataFrame:
    """The concept of a code in another scheme; aliases (scheme, term) name the scheme without regard to case."""
    scheme = aliases.filter(F.lower("term") == alias.lower()).select("scheme")
    return identifiers.filter(F.col("alt_code") == alt_code).join(scheme, "scheme", "left_semi").select("code").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").intersect(b.select("code"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").unionByName(b.select("code")).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").subtract(b.select("code"))


def top_of(codes: DataFrame, closure: DataFrame) -> DataFrame:
    """Members of the set without an ancestor in it."""
    below = closure.join(codes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("code"))
    return codes.select("code").distinct().join(below, "code", "left_anti")


def bottom_of(codes: DataFrame, closure: DataFrame) -> DataFrame:
    """Members of the set without a descendant in it."""
    above = closure.join(codes.select(F.col("code").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("code"))
    return codes.select("code").distinct().join(above, "code", "left_anti")


def over_all(concepts: DataFrame, edges: DataFrame, operator: str) -> DataFrame:
    """Hierarchy operators over every concept, without the closure."""
    side = {"descendants": "child", "children": "child", "ancestors": "parent", "parents": "parent"}[operator]
    return concepts.select("code").distinct().join(edges.select(F.col(side).alias("code")), "code", "left_semi")


def dotted(codes: DataFrame, attributes: DataFrame, kinds: list[DataFrame]) -> DataFrame:
    """Values of attributes of each source, step by step; each step is a set of attribute kinds."""
    for kind in kinds:
        steps = attributes.filter("target IS NOT NULL").join(kind.select(F.col("code").alias("kind")), "kind", "left_semi")
        codes = steps.join(codes.select(F.col("code").alias("source")), "source", "left_semi").select(F.col("target").alias("code")).distinct()
    return codes


# reference sets


def member_of(refsets: DataFrame, members: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Components of active members of the sets; a set without any member row is an error where concepts is given."""
    if concepts is not None and not refsets.join(members.select(F.col("refset_id").alias("code")), "code", "left_anti").isEmpty():
        raise UnknownConcept("a focus concept is not a reference set")
    return members.filter("active").join(refsets.select(F.col("code").alias("refset_id")), "refset_id", "left_semi").select("code").distinct()


def member_fields(refsets: DataFrame, members: DataFrame, concepts: DataFrame, fields: list[str]) -> DataFrame:
    """Concepts in the chosen fields of active members (`*`: all fields and the component itself); an unknown field is an error."""
    chosen = members.filter("active").join(refsets.select(F.col("code").alias("refset_id")), "refset_id", "left_semi")
    if fields == ["*"]:
        values = F.concat(F.array("code"), F.map_values("fields"))
    else:
        named = [f for f in fields if f != "referencedComponentId"]
        if named:
            known = chosen.select(F.explode(F.map_keys("fields")).alias("f")).distinct().filter(F.col("f").isin(named))
            if known.count() < len(set(named)):
                raise UnknownConcept(f"no set has all fields {named}")
        values = F.array(*[F.col("code") if f == "referencedComponentId" else F.col("fields")[f] for f in fields])
    return chosen.select(F.explode(values).alias("code")).filter("code IS NOT NULL").join(concepts.select("code"), "code", "left_semi").distinct()


def refsets_containing(codes: DataFrame, members: DataFrame, concepts: DataFrame) -> DataFrame:
    """Sets with an active member among the codes, where the set is itself a known concept."""
    found = members.filter("active").join(codes.select("code"), "code", "left_semi").select(F.col("refset_id").alias("code")).distinct()
    return found.join(concepts.select("code"), "code", "left_semi")


def member_filter(
    members: DataFrame, active: bool | None = None, time: tuple[str, int] | None = None, module: list[str] | None = None,
    fields: dict[str, tuple[str, str, object]] | None = None,
) -> DataFrame:
    """Member rows that pass. fields: name -> (kind, comparison, value), kind one of concept, number, string, boolean, time.

    A concept's value is a DataFrame[code] (with = or !=); the others are literals.
    """
    out = members
    if active is not None:
        out = out.filter(F.col("active") == active)
    if time:
        out = out.filter(compare(F.col("effective_time"), time[0], F.lit(time[1])))
    if module:
        out = out.filter(F.col("module").isin(module))
    for name, (kind, how, value) in (fields or {}).items():
        column = F.col("fields")[name]
        if kind == "concept":
            inside = out.filter(column.isNotNull()).withColumn("_value", column)
            other = value.select(F.col("code").alias("_value"))
            out = inside.join(other, "_value", "left_semi" if how == "=" else "left_anti").drop("_value")
        elif kind == "number":
            out = out.filter(compare_numbers(column.try_cast("double"), how, F.lit(float(value))))
        elif kind == "string":
            out = out.filter(compare(column, how, F.lit(value)))
        elif kind == "boolean":
            out = out.filter(compare(column.isin("1", "true"), how, F.lit(bool(value))))
        elif kind == "time":
            out = out.filter(compare(column.try_cast("int"), how, F.lit(int(value))))
        else:
            raise ValueError(f"unknown kind {kind}")
    return out


# comparisons


def compare(a: Column, how: str, b: Column) -> Column:
    made = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return made[how]


def compare_numbers(a: Column, how: str, b: Column) -> Column:
    """Numbers within EPSILON are equal."""
    near = F.abs(a - b) < EPSILON
    made = {"=": near, "!=": ~near, "<": (a < b) & ~near, "<=": (a < b) | near, ">": (a > b) & ~near, ">=": (a > b) | near}
    return made[how]


# refinement


@dataclass(frozen=True)
class AttributeTest:
    """One attribute constraint: kinds (None: any), a value test and a cardinality.

    values: None is any value of any type; a DataFrame[code] is a set of targets, with negate for
    rows whose value is outside it; (comparison, number), (comparison, string) and (comparison,
    boolean) are for concrete values.
    """

    kinds: list[str] | None = None
    values: DataFrame | tuple | None = None
    negate: bool = False
    least: int = 1
    most: int | None = None

    @property
    def named(self) -> Column:
        """Rows of the kinds asked for."""
        return F.lit(True) if self.kinds is None else F.col("kind").isin(self.kinds)

    @property
    def condition(self) -> Column | None:
        """The test as a condition on a row; None where the values are a table."""
        if isinstance(self.values, DataFrame):
            return None
        if self.values is None:
            return self.named
        how, value = self.values
        if isinstance(value, bool):
            fits = compare(F.lower("text").isin("true", "1"), how, F.lit(value))
        elif isinstance(value, (int, float)):
            fits = compare_numbers(F.col("number"), how, F.lit(float(value)))
        elif isinstance(value, (list, tuple, set)):
            inside = F.col("text").isin(list(value))
            fits = inside if how == "=" else ~inside
        else:
            fits = compare(F.col("text"), how, F.lit(value))
        return self.named & fits

    def rows(self, attributes: DataFrame) -> DataFrame:
        if isinstance(self.values, DataFrame):
            other = self.values.select(F.col("code").alias("target"))
            return attributes.filter(self.named & F.col("target").isNotNull()).join(other, "target", "left_anti" if self.negate else "left_semi")
        return attributes.filter(self.condition)

    def within(self, n: Column) -> Column:
        n = F.coalesce(n, F.lit(0))
        return (n >= self.least) if self.most is None else (n >= self.least) & (n <= self.most)


def refine(focus: DataFrame, attributes: DataFrame, test: AttributeTest) -> DataFrame:
    """Sources in focus with a fitting number of matching rows. The default cardinality is a semi join."""
    rows = test.rows(attributes).select(F.col("source").alias("code"))
    if test.least == 1 and test.most is None:
        return focus.select("code").join(rows, "code", "left_semi")
    return focus.select("code").join(rows.groupBy("code").count(), "code", "left").filter(test.within(F.col("count"))).select("code")


def refine_group(focus: DataFrame, attributes: DataFrame, tests: list[AttributeTest], how: str = "and", least: int = 1, most: int | None = None) -> DataFrame:
    """Sources in focus with a fitting number of role groups that meet the tests together.

    Each row of group 0 is a group of its own. Within a group each test counts its own matching
    rows; how joins the tests. Rows that no test matches are read only where a group may fit without
    any match. All tests of rows are asked in one scan, those of tables in one more each, and
    groups are counted before they meet focus. With least 0 sources without any group count as
    having none that fits.
    """
    group = ["source", F.col("role_group").alias("_group"), F.when(F.col("role_group") == 0, F.col("row_id")).alias("_row")]
    empty = [t.least == 0 for t in tests]
    alone = all(empty) if how == "and" else any(empty)

    def marks(hit: dict[int, Column]) -> list[Column]:
        return [hit.get(i, F.lit(False)).alias(f"_t{i}") for i in range(len(tests))]

    own = {i: t.condition for i, t in enumerate(tests) if t.condition is not None}
    scans = [t.rows(attributes).select(*group, *marks({i: F.lit(True)})) for i, t in enumerate(tests) if i not in own]
    if own or alone:
        rows = attributes if alone else attributes.filter(reduce(lambda a, b: a | b, own.values()))
        scans.append(rows.select(*group, *marks(own)))
    fits = [t.within(F.count_if(f"_t{i}")) for i, t in enumerate(tests)]
    whole = reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), fits)
    groups = reduce(DataFrame.unionByName, scans).groupBy("source", "_group", "_row").agg(whole.alias("_fits"))
    per_source = groups.groupBy("source").agg(F.count_if("_fits").alias("n")).withColumnRenamed("source", "code")
    n = F.coalesce("n", F.lit(0))
    return focus.select("code").join(per_source, "code", "left").filter((n >= least) if most is None else n.between(least, most)).select("code")


def refine_reverse(focus: DataFrame, attributes: DataFrame, sources: DataFrame, kinds: list[str] | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """Targets in focus whose incoming rows from the sources number between least and most."""
    rows = attributes.filter("target IS NOT NULL") if kinds is None else attributes.filter(F.col("kind").isin(kinds) & F.col("target").isNotNull())
    rows = rows.join(sources.select(F.col("code").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("code")).count()
    n = F.coalesce("count", F.lit(0))
    return focus.select("code").join(rows, "code", "left").filter((n >= least) if most is None else n.between(least, most)).select("code")


# concept and description filters


def concept_filter(
    focus: DataFrame, concepts: DataFrame, active: bool | None = None, definition: list[str] | None = None, module: list[str] | None = None,
    time: tuple[str, int] | None = None,
) -> DataFrame:
    out = concepts
    if active is not None:
        out = out.filter(F.col("active") == active)
    if definition:
        out = out.filter(F.col("definition_status").isin(definition))
    if module:
        out = out.filter(F.col("module").isin(module))
    if time:
        out = out.filter(compare(F.col("effective_time"), time[0], F.lit(time[1])))
    return focus.select("code").join(out.select("code"), "code", "left_semi")


# Aliases of dialects and the language reference sets they name.
DIALECTS = {
    "da-dk": "554461000005103",
    "de": "722130004",
    "en-au": "32570271000036106",
    "en-ca": "19491000087109",
    "en-gb": "900000000000508004",
    "en-gb-x-drug": "999000681000001101",
    "en-gb-x-ext": "999001251000000103",
    "en-ie": "21000220103",
    "en-nz": "271000210107",
    "en-nz-x-pat": "281000210109",
    "en-us": "900000000000509007",
    "en-x-gmdn": "608771002",
    "en-x-nhs-clinical": "999001261000000100",
    "en-x-nhs-dmd": "999000671000001103",
    "en-x-nhs-pharmacy": "999000691000001104",
    "es": "450828004",
    "es-uy": "5641000179103",
    "et-ee": "71000181105",
    "fr": "722131000",
    "fr-be": "21000172104",
    "fr-ca": "20581000087109",
    "ja": "722129009",
    "mi": "291000210106",
    "nb-no": "61000202103",
    "nl-be": "31000172101",
    "nl-nl": "31000146106",
    "nn-no": "91000202106",
    "sv-se": "46011000052107",
    "zh": "722128001",
}


@dataclass(frozen=True)
class DescriptionTest:
    """Predicates that one description must meet together; inactive ones take part only when asked for."""

    words: list[str] = field(default_factory=list)  # any of them; each a list of word starts
    wild: list[str] = field(default_factory=list)
    languages: list[str] | None = None
    uses: list[str] | None = None
    ids: list[str] | None = None
    active: bool | None = True
    dialects: dict[str, list[str] | None] | None = None  # language set, by id or alias -> its own acceptabilities (None: the shared ones)
    acceptabilities: list[str] | None = None  # shared by dialects without own ones (None: any)
    aliases: dict[str, str] = field(default_factory=lambda: DIALECTS)
    modules: list[str] | None = None
    time: tuple[str, int] | None = None

    def _refset(self, dialect: str) -> str:
        """A dialect's language set: an alias in any case, or the set's own id; a word that is neither is an error."""
        known = self.aliases.get(dialect.lower())
        if known is None and re.fullmatch("[A-Za-z]{2,3}(-[A-Za-z0-9]+)*", dialect):
            raise UnknownConcept(f"no language set has the alias {dialect}")
        return known or dialect

    def rows(self, designations: DataFrame, acceptability: DataFrame | None = None) -> DataFrame:
        out = designations
        if self.active is not None:
            out = out.filter(F.col("active") == self.active)
        if self.words or self.wild:
            tests = [starts_words(F.col("term"), F.lit(w)) for w in self.words] + [matches_wildcard(F.col("term"), w) for w in self.wild]
            out = out.filter(reduce(lambda a, b: a | b, tests))
        if self.languages:
            out = out.filter(F.lower("language").isin([x.lower() for x in self.languages]))
        if self.uses:
            out = out.filter(F.col("use_code").isin(self.uses))
        if self.ids:
            out = out.filter(F.col("designation_id").isin(self.ids))
        if self.modules:
            out = out.filter(F.col("module").isin(self.modules))
        if self.time:
            out = out.filter(compare(F.col("effective_time"), self.time[0], F.lit(self.time[1])))
        if self.dialects:
            fit = [(F.col("refset_id") == self._refset(r)) & (F.lit(True) if (own := a or self.acceptabilities) is None else F.col("acceptability").isin(own)) for r, a in self.dialects.items()]
            out = out.join(acceptability.filter(reduce(lambda a, b: a | b, fit)).select("designation_id"), "designation_id", "left_semi")
        return out


def description_filter(focus: DataFrame, designations: DataFrame, test: DescriptionTest, acceptability: DataFrame | None = None) -> DataFrame:
    return focus.select("code").join(test.rows(designations, acceptability).select("code"), "code", "left_semi")


#: Which association sets each profile follows, by the roles that the caller names the sets with.
HISTORY = {"min": ["same-as"], "mod": ["same-as", "replaced-by", "was-a", "partially-equivalent-to"]}


def with_history(codes: DataFrame, members: DataFrame, profile: str | list[str] = "max", all_sets: DataFrame | None = None) -> DataFrame:
    """codes and the concepts whose active association rows point at them.

    profile: `min`, `mod`, `max` (every set of all_sets) or a list of set ids.
    """
    rows = members.filter("active")
    if profile == "max":
        rows = rows if all_sets is None else rows.join(all_sets.select(F.col("code").alias("refset_id")), "refset_id", "left_semi")
    else:
        rows = rows.filter(F.col("refset_id").isin(HISTORY[profile] if isinstance(profile, str) else profile))
    old = rows.select("code", F.col("fields")["targetComponentId"].alias("_to")).join(codes.select(F.col("code").alias("_to")), "_to", "left_semi")
    return either(codes, old)


@dataclass(frozen=True)
class Terminology:
    """The tables of one version of a code system."""

    concepts: DataFrame
    edges: DataFrame
    closure: DataFrame
    attributes: DataFrame | None = None
    members: DataFrame | None = None
    designations: DataFrame | None = None
    acceptability: DataFrame | None = None

    def concept(self, *codes: str) -> ConceptSet:
        return ConceptSet(self, self_of(self.concepts, list(codes)))

    def all(self) -> ConceptSet:
        return ConceptSet(self, any_of(self.concepts))


@dataclass(frozen=True)
class ConceptSet:
    """A set of concepts with the operators as methods; df is its DataFrame[code]."""

    t: Terminology
    df: DataFrame

    def _new(self, df: DataFrame) -> ConceptSet:
        return ConceptSet(self.t, df)

    def descendants(self, or_self: bool = False) -> ConceptSet:
        return self._new(H.descendants(self.df, self.t.closure, or_self))

    def ancestors(self, or_self: bool = False) -> ConceptSet:
        return self._new(H.ancestors(self.df, self.t.closure, or_self))

    def children(self, or_self: bool = False) -> ConceptSet:
        found = H.children(self.df, self.t.edges)
        return self._new(either(found, self.df) if or_self else found)

    def parents(self, or_self: bool = False) -> ConceptSet:
        found = H.parents(self.df, self.t.edges)
        return self._new(either(found, self.df) if or_self else found)

    def top(self) -> ConceptSet:
        return self._new(top_of(self.df, self.t.closure))

    def bottom(self) -> ConceptSet:
        return self._new(bottom_of(self.df, self.t.closure))

    def both(self, other: ConceptSet) -> ConceptSet:
        return self._new(both(self.df, other.df))

    def either(self, other: ConceptSet) -> ConceptSet:
        return self._new(either(self.df, other.df))

    def minus(self, other: ConceptSet) -> ConceptSet:
        return self._new(minus(self.df, other.df))

    def members(self) -> ConceptSet:
        return self._new(member_of(self.df, self.t.members, self.t.concepts))

    def where_attribute(self, test: AttributeTest) -> ConceptSet:
        return self._new(refine(self.df, self.t.attributes, test))

    def where_group(self, tests: list[AttributeTest], how: str = "and", least: int = 1, most: int | None = None) -> ConceptSet:
        return self._new(refine_group(self.df, self.t.attributes, tests, how, least, most))

    def where_description(self, test: DescriptionTest) -> ConceptSet:
        return self._new(description_filter(self.df, self.t.designations, test, self.t.acceptability))

    def history(self, profile: str | list[str] = "max") -> ConceptSet:
        return self._new(with_history(self.df, self.t.members, profile))
