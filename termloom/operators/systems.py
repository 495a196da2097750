"""Selections that belong to one kind of code system, and small rules of builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.identifiers import checked_number_reason, concept_id_reason, namespace
from termloom.operators import hierarchy as H
from termloom.tables import cut, small

# LOINC-like tables: terms (code, columns...), links (code, part, axis), parts (part, name), answers (list, answer, sequence), lists (code, list)


def axis_filter(terms: DataFrame, links: DataFrame, parts: DataFrame, axis: str, op: str, value: str | list[str]) -> DataFrame:
    """Terms whose part on an axis, by its code or name, or else whose column of that name, passes =, in or regex."""
    values = [value] if isinstance(value, str) else value
    test = (lambda c: c.rlike(f"^(?:{values[0]})$")) if op == "regex" else (lambda c: c.isin(values))
    linked = links.filter(F.col("axis") == axis).join(parts.select("part", "name"), "part", "left").filter(test(F.col("part")) | test(F.col("name"))).select("code")
    own = terms.filter(test(F.col(axis))).select("code") if axis in terms.columns else terms.select("code").limit(0)
    return linked.unionByName(own).distinct()


def part_filter(edges: DataFrame, closure: DataFrame, parts: DataFrame, op: str, value: str) -> DataFrame:
    """Children (`parent`) or everything below (`ancestor`) of parts named by code or name."""
    named = parts.filter((F.col("part") == value) | (F.col("name") == value)).select(F.col("part").alias("code")).distinct()
    return H.children(named, edges) if op == "parent" else H.descendants(named, closure)


def answers_of(lists: DataFrame, answers: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, answer, sequence) of lists named themselves or linked to a term."""
    own = codes.select("code", F.col("code").alias("list"))
    linked = lists.join(codes.select("code"), "code", "left_semi").select("code", "list")
    return own.unionByName(linked).join(answers, "list").select("code", "answer", "sequence").distinct()


def document_axis(links: DataFrame, parts: DataFrame, axes: list[str], value: str | None = None) -> DataFrame:
    """Terms with any part on the axes, or the named one."""
    on = links.filter(F.col("axis").isin(axes))
    if value is not None:
        on = on.join(parts.filter((F.col("part") == value) | (F.col("name") == value)).select("part"), "part", "left_semi")
    return on.select("code").distinct()


def status_active(status: Column) -> Column:
    return F.coalesce(F.upper(status) != "DEPRECATED", F.lit(True))


# RxNorm-like tables

#: Term types in the order of preference for a display.
TERM_TYPES = ["SCD", "SBD", "GPCK", "BPCK", "SCDG", "SBDG", "SCDF", "SBDF", "SCDC", "SBDC", "MIN", "PIN", "IN", "BN", "DFG", "DF"]


def rank_atoms(atoms: DataFrame, own_source: str, types: list[str] = TERM_TYPES) -> DataFrame:
    """atoms (concept, atom, source, type, name) with `place`: own source by preferred type first, then source, type, name, id."""
    order = F.array(*[F.lit(t) for t in types])
    own = F.when(F.col("source") == own_source, F.coalesce(F.nullif(F.array_position(order, F.col("type")), F.lit(0)), F.lit(len(types) + 1))).otherwise(F.lit(len(types) + 2))
    return atoms.withColumn("place", F.row_number().over(Window.partitionBy("concept").orderBy(own, "source", "type", "name", "atom")))


def atom_relations(relations: DataFrame, atoms: DataFrame, own_source: str) -> DataFrame:
    """(source, kind, target) from second to first end; REL and RELA each an edge; atom ends resolved to concepts."""
    of = lambda n: atoms.select(F.col("atom").alias(f"atom{n}"), F.col("concept").alias(f"_c{n}"))
    rows = relations.filter(F.col("source_name") == own_source).join(of(1), "atom1", "left").join(of(2), "atom2", "left")
    ends = rows.select(F.coalesce("concept2", "_c2").alias("source"), F.explode(F.array("rel", "rela")).alias("kind"), F.coalesce("concept1", "_c1").alias("target"))
    return ends.dropna().distinct()


def relation_filter(relations: DataFrame, atoms: DataFrame, kind: str, value: str) -> DataFrame:
    """Concepts with a relation of a kind to a concept, or to an atom's concept."""
    targets = atoms.filter(F.col("atom") == value).select(F.col("concept").alias("target")).unionByName(atoms.sparkSession.createDataFrame([(value,)], "target string"))
    return relations.filter(F.col("kind") == kind).join(targets, "target", "left_semi").select(F.col("source").alias("code")).distinct()


def indexed_filter(attributes: DataFrame, name: str, values: list[str]) -> DataFrame:
    return attributes.filter((F.col("name") == name) & F.col("value").isin(values)).select("code").distinct()


# classifications


def longest_prefix_parent(new: DataFrame, known: DataFrame, filler: str = "X", separator: str = ".") -> DataFrame:
    """(code, parent): the longest known proper prefix of each new code, without fillers or a separator at its end; null where none is."""
    bare = F.regexp_replace("code", f"[{filler}{separator}]+$", "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(bare))), lambda n: F.rtrim(F.substring(bare, F.lit(1), n), F.lit(separator)))
    spread = new.select("code", F.explode(F.array_distinct(prefixes)).alias("prefix")).filter("prefix != code")
    best = spread.join(known.select(F.col("code").alias("prefix")), "prefix", "left_semi").groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return new.select("code").join(best, "code", "left")


def prefix_level_parent(codes: DataFrame, lengths: tuple[int, ...] = (1, 3, 4, 5, 7)) -> DataFrame:
    """(code, level, parent, missing): parents by code length; missing where the parent is not among the codes."""
    level, parent = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, n in enumerate(lengths):
        level = F.when(F.length("code") == n, i + 1).otherwise(level)
        if i:
            parent = F.when(F.length("code") == n, F.substring("code", 1, lengths[i - 1])).otherwise(parent)
    out = codes.select("code").distinct().withColumn("level", level).withColumn("parent", parent)
    known = codes.select(F.col("code").alias("parent"), F.lit(True).alias("_known")).distinct()
    return out.join(known, "parent", "left").select("code", "level", "parent", (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("missing"))


def expand_modifiers(classes: DataFrame, modified_by: DataFrame, modifier_classes: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(code, parent, title): each class with each class of the modifiers it takes, less exclusions; modified_by is (code, modifier)."""
    met = modified_by.join(modifier_classes.select("modifier", "suffix", F.col("title").alias("_more")), "modifier").join(exclusions, ["code", "suffix"], "left_anti")
    return met.join(classes.select("code", "title"), "code").select(F.concat("code", "suffix").alias("code"), F.col("code").alias("parent"), F.concat_ws(", ", "title", "_more").alias("title"))


def merge_order(tabular: DataFrame, order: DataFrame) -> DataFrame:
    """Order rows (code, header, short, long) onto a tabular list (code, title): flags and short titles on known codes, new classes for the rest."""
    both = tabular.join(order, "code", "full_outer")
    return both.select("code", F.coalesce("title", "long").alias("title"), "short", (~F.coalesce("header", F.lit(True))).alias("valid"), F.col("title").isNull().alias("new"))


def ladder(levels: list[DataFrame]) -> DataFrame:
    """Rungs above each product: levels are (code, parent) from the bottom up; rung1, rung2, ... of the lowest level's codes."""
    out = levels[0].select("code", F.col("parent").alias("rung1"))
    for i, level in enumerate(levels[1:], 2):
        up = level.select(F.col("code").alias(f"rung{i - 1}"), F.col("parent").alias(f"rung{i}"))
        out = out.join(up, f"rung{i - 1}", "left")
    return out.select("code", *[f"rung{i}" for i in range(1, len(levels) + 1)])


# ICD-11-like axes


def axis_value_check(asked: DataFrame, scales: DataFrame, closure: DataFrame) -> DataFrame:
    """asked (id, stem, value, filled: axes already filled) with the axis that takes the value; null where none does.

    scales are (stem, axis, required, declared, entity). A listed entity holds itself and all below
    it; an unfilled axis comes first, then required ones, then the declared order.
    """
    entities = scales.select("entity").distinct()
    below = closure.select(F.col("descendant").alias("value"), F.col("ancestor").alias("entity")).join(small(entities), "entity").unionByName(entities.select(F.col("entity").alias("value"), "entity"))
    order = F.struct((~F.col("required")).cast("int").alias("optional"), "declared", "axis")
    axes = below.join(small(scales), "entity").groupBy("stem", "value").agg(F.sort_array(F.collect_set(order)).alias("_axes"))  # one row a value, however many ask for it
    free = F.get(F.filter("_axes", lambda x: ~F.coalesce(F.array_contains("filled", x["axis"]), F.lit(False))), F.lit(0))
    return asked.join(axes, ["stem", "value"], "left").withColumn("axis", F.coalesce(free, F.get("_axes", F.lit(0)))["axis"]).select(*asked.columns, "axis")


# definitions


def normal_form_table(edges: DataFrame, attributes: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(code, form): parents, then ungrouped attributes, then role groups in braces, all in the order of their codes.

    With terms (code, display) every code that has one is followed by it between bars; kinds of attributes too, where they are codes with terms.
    Rows move once, to the task of their source, and only those with a target move to its term before.
    """
    number = F.coalesce(F.col("number").try_cast("decimal(38,2)").cast("string"), F.format_string("%.2f", "number"))  # the second for what no decimal holds
    plain = F.coalesce("target", F.when(F.col("number").isNotNull(), F.concat(F.lit("#"), number)), F.concat(F.lit('"'), "text", F.lit('"')))
    rows, parents = attributes.select("source", "role_group", "kind", plain.alias("_plain"), "target"), edges.select("child", "parent")
    if terms is None:
        # forms of codes are their own order
        rows = rows.select("source", "role_group", F.concat("kind", F.lit("="), "_plain").alias("_pair")).repartition("source")
        ordered = F.sort_array
        pair, parent = F.col("_pair"), F.col("parent")
        parents = parents.repartition("child").distinct()
    else:
        term = lambda code, name: terms.select(F.col("code").alias(code), F.col("display").alias(name))
        shown = lambda c, t: F.when(F.col(t).isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.lit(" |"), t, F.lit("|")))
        kinds = small(attributes.select("kind").distinct().join(term("kind", "_of_kind"), "kind"))
        known = rows.filter("target IS NOT NULL").join(term("target", "_of_target"), "target", "left").select("source", "role_group", "kind", "_plain", "_of_target")
        rest = rows.filter("target IS NULL").select("source", "role_group", "kind", "_plain", F.lit(None).cast("string").alias("_of_target"))
        rows = known.unionByName(rest).repartition("source").join(kinds, "kind", "left")
        ordered = lambda c: F.transform(F.sort_array(c), lambda x: x["text"])
        pair = F.struct(F.concat("kind", F.lit("="), "_plain").alias("order"), F.concat(shown("kind", "_of_kind"), F.lit("="), shown("_plain", "_of_target")).alias("text"))
        parents = parents.distinct().join(term("parent", "_of_parent"), "parent", "left")
        parent = F.struct(F.col("parent").alias("order"), shown("parent", "_of_parent").alias("text"))
    groups = rows.groupBy("source", "role_group").agg(F.collect_list(pair).alias("_pairs"))
    braces = lambda c: F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))
    braced = braces(ordered("_pairs"))
    if terms is not None:
        braced = F.struct(braces(F.transform(F.sort_array("_pairs"), lambda x: x["order"])).alias("order"), braced.alias("text"))
    plainly = F.col("role_group") == 0
    groups = groups.select("source", F.when(plainly, F.array_join(ordered("_pairs"), ",")).alias("_text"), F.when(F.col("role_group") != 0, braced).alias("_braced"))
    per = groups.groupBy(F.col("source").alias("code")).agg(F.max("_text").alias("_plain"), ordered(F.collect_list("_braced")).alias("_groups"))
    up = parents.groupBy(F.col("child").alias("code")).agg(F.array_join(ordered(F.collect_list(parent)), "+").alias("_up"))
    right = F.array_join(F.filter(F.concat(F.array("_plain"), F.coalesce("_groups", F.array().cast("array<string>"))), lambda x: x.isNotNull()), ",")
    return up.join(per, "code", "full_outer").select("code", F.concat_ws(":", "_up", F.nullif(right, F.lit(""))).alias("form"))


def resource_status(properties: DataFrame, concepts: DataFrame) -> DataFrame:
    """(code, inactive, not_selectable) from properties inactive=true, status=retired and notSelectable=true."""
    flags = properties.groupBy("code").agg(
        F.bool_or(((F.col("property") == "inactive") & (F.col("value_text") == "true")) | ((F.col("property") == "status") & F.col("value_text").isin("retired", "inactive"))).alias("inactive"),
        F.bool_or((F.col("property") == "notSelectable") & (F.col("value_text") == "true")).alias("not_selectable"),
    )
    return concepts.select("code").join(flags, "code", "left").select("code", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("inactive", "not_selectable")])


def identifier_audit(ids: DataFrame, column: str = "id", kind: str = "component") -> DataFrame:
    """(reason, n): how many identifiers are malformed, by the first reason; well-formed ones count as `ok`.

    kind is `component` (check digits of the dihedral scheme) or `number` (a hyphen and a mod-10 digit).
    """
    reason = {"component": concept_id_reason, "number": checked_number_reason}[kind](F.col(column))
    return ids.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


class AmbiguousEdition(ValueError):
    pass


def identify_edition(dependencies: DataFrame, core: str, date: int, strict: bool = False) -> DataFrame:
    """(module, effective_time, namespaced, picked): modules that depend on others and that none depends on, and the one that names the edition.

    One root with a namespace is picked; of several the one of the release date (of several such the
    least). Without any, the release is the international one: the core module is picked, though
    others depend on it, or, where it does not occur, the only root. dependencies are (module,
    source_time, target, target_time). With strict, a release where none can be picked is an error.
    """
    ends = dependencies.select("module", F.col("source_time").alias("time"), F.lit(True).alias("_needs")).unionByName(dependencies.select(F.col("target").alias("module"), F.col("target_time").alias("time"), F.lit(False).alias("_needs")))
    modules = ends.groupBy("module").agg(F.max("time").alias("effective_time"), F.max("_needs").alias("_needs"))
    needed = dependencies.filter("module != target").select(F.col("target").alias("module")).distinct().withColumn("_needed", F.lit(True))
    found = cut(modules.join(needed, "module", "left").withColumn("namespaced", namespace(F.col("module")).isNotNull()).withColumn("root", F.col("_needed").isNull() & F.col("_needs")), "modules")
    named = F.col("root") & F.col("namespaced")
    counts = found.agg(
        F.count_if(named).alias("named"), F.min(F.when(named, F.col("module"))).alias("only_named"), F.min(F.when(named & (F.col("effective_time") == date), F.col("module"))).alias("dated"),
        F.count_if(F.col("root")).alias("roots"), F.min(F.when(F.col("root"), F.col("module"))).alias("only_root"), F.max(F.col("module") == core).alias("has_core"),
    ).first()
    if counts.named:
        pick = counts.only_named if counts.named == 1 else counts.dated
    else:
        pick = core if counts.has_core else counts.only_root if counts.roots == 1 else None
    if strict and pick is None:
        raise AmbiguousEdition(f"{counts.named or counts.roots} root modules, and none that names the edition")
    shown = found.filter(F.col("root") | F.col("module").eqNullSafe(F.lit(pick)))
    return shown.select("module", "effective_time", "namespaced", F.col("module").eqNullSafe(F.lit(pick)).alias("picked"))


def check_layer(needs: DataFrame, edition: DataFrame) -> DataFrame:
    """needs (module, target, target_time) with outcome: met, missing or older, against edition (module, effective_time)."""
    have = edition.select(F.col("module").alias("target"), F.col("effective_time").alias("_have"))
    outcome = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") < F.col("target_time"), "older").otherwise("met")
    return needs.join(have, "target", "left").withColumn("outcome", outcome).drop("_have")
