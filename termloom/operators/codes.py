"""Bulk code operations on fact tables: lookup, displays, validation and translation.

Facts carry a row key and system, code and, where they have them, version and display. Every
operation is a left join with outcome columns: bad rows become rows with reasons, never errors.
Tables of systems may have several versions of one; the greatest counts, unless concepts come as intervals
(see versioned.code_intervals): then each fact counts in the version that it names. A fact stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import primary_language
from termloom.functions.versions import version_key, version_matches
from termloom.tables import cut, small

# codes


def keys_of(*frames: DataFrame) -> list[str]:
    """What joins codes: system and code where all frames name the system, else the code alone."""
    return ["system", "code"] if all("system" in f.columns for f in frames) else ["code"]


def code_key(code: Column, case_sensitive: Column) -> Column:
    """A code as its system compares it."""
    return F.when(F.coalesce(case_sensitive, F.lit(True)), code).otherwise(F.lower(code))


def current(systems: DataFrame) -> DataFrame:
    """One row a system: that of its greatest version, by segments."""
    rest = [c for c in systems.columns if c != "system"]
    order = F.struct(version_key(F.col("version")), "version") if "version" in rest else F.struct(*rest)
    return systems.groupBy("system").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("system", "_row.*")


def by_version(concepts: DataFrame) -> bool:
    """Whether concepts are intervals of releases."""
    return "from_no" in concepts.columns


def known_codes(concepts: DataFrame, systems: DataFrame, *columns: str) -> DataFrame:
    """(system, _key, _own): each known code by its key, with its own spelling and columns; of codes that differ in case alone in a case-blind system, the least."""
    keyed = concepts.join(systems.select("system", "case_sensitive"), "system", "left")
    return keyed.groupBy("system", code_key(F.col("code"), F.col("case_sensitive")).alias("_key")).agg(F.min(F.struct("code", *columns)).alias("_own"))


def with_own(facts: DataFrame, concepts: DataFrame, systems: DataFrame, *columns: str, by_shuffle: bool = False) -> DataFrame:
    """facts (system, code) with _own: the code in the system's own spelling, and columns of its concept; null where it is not known.

    by_shuffle: many codes are known, so that they are not to be sent to every executor, however small they are when compressed.
    Where concepts are intervals, facts have release_no and systems are numbered releases.
    """
    if by_version(concepts):
        keyed = facts.join(systems.select("system", "release_no", "case_sensitive"), ["system", "release_no"], "left").withColumn("_key", code_key(F.col("code"), F.col("case_sensitive")))
        known = concepts.select(F.col("system").alias("_k_system"), F.col("key").alias("_k_key"), "from_no", "to_no", F.struct("code", *columns).alias("_own"))
        on = (F.col("system") == F.col("_k_system")) & (F.col("_key") == F.col("_k_key")) & F.col("release_no").between(F.col("from_no"), F.col("to_no"))
        return keyed.join(known, on, "left").drop("_k_system", "_k_key", "from_no", "to_no", "_key", "case_sensitive")
    systems = current(systems)
    keyed = facts.join(systems.select("system", "case_sensitive"), "system", "left").withColumn("_key", code_key(F.col("code"), F.col("case_sensitive")))
    known = known_codes(concepts, systems, *columns)
    return keyed.join(known.hint("merge") if by_shuffle else known, ["system", "_key"], "left").drop("_key", "case_sensitive")


def _resolved(facts: DataFrame, concepts: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """facts with what their version resolves to, where concepts are intervals; systems with one row for each of the keys that follow."""
    if not by_version(concepts):
        return facts, current(systems), ["system"]
    from termloom.operators.versioned import resolve_releases

    return resolve_releases(facts, systems), systems, ["system", "release_no"]


# lookup and displays


def lookup(facts: DataFrame, concepts: DataFrame, systems: DataFrame, designations: DataFrame, properties: DataFrame, names: list[str] | None = None) -> DataFrame:
    """facts with name, version, display, active, designations and properties of their code, and its definition where concepts have one.

    Codes of case-blind systems are found in any case. Designations and properties are gathered for
    the codes that facts hold, one row a code, before they meet the facts; designations with a system
    meet codes of that system only. Where concepts are intervals, facts may name a version, and version
    tells the one that counts; a version that is not there leaves everything null.
    """
    facts, systems, keys = _resolved(facts, concepts, systems)
    wanted = facts.select(*keys, "code").distinct()
    told = [c for c in ("display", "active", "definition") if c in concepts.columns]
    own = with_own(wanted, concepts, systems, *told).select(*keys, "code", "_own")
    asked = own.filter("_own IS NOT NULL").select("system", F.col("_own.code").alias("code")).distinct()
    on = keys_of(designations)
    terms = designations.filter("active").join(asked.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("language", "use_code", "term"))).alias("designations"))
    chosen = properties if names is None else properties.filter(F.col("property").isin(names))
    props = chosen.join(asked, ["system", "code"], "left_semi").groupBy("system", "code").agg(F.sort_array(F.collect_list(F.struct("property", "value_text"))).alias("properties"))
    about = asked.join(terms, on, "left").join(props, ["system", "code"], "left").withColumnRenamed("code", "_code")
    found = own.withColumn("_code", F.col("_own.code")).join(about, ["system", "_code"], "left").join(systems.select(*keys, F.col("version").alias("_version")), keys, "left")
    more = [F.col("_own.definition").alias("definition")] if "definition" in told else []
    found = found.select(*keys, "code", F.col("_own.display").alias("name"), F.col("_own.active").alias("active"), *more, "designations", "properties", "_version")
    out = facts.drop("version").join(found, [*keys, "code"], "left").withColumnRenamed("_version", "version")
    return out.drop("release_no", "release", "release_error")


def language_ranks(header: str, available: list[str]) -> list[tuple[str, int]]:
    """Available languages in the order a quality-ordered list of ranges prefers them; q=0 refuses; `*` takes the rest."""
    asked = []
    for i, part in enumerate(header.split(",")):
        tag, *more = [x.strip() for x in part.split(";")]
        q = next((float(x[2:]) for x in more if x.startswith("q=")), 1.0)
        if tag:
            asked.append((-q, i, tag.lower()))
    refused = {t for q, _, t in asked if q == 0}
    out: list[str] = []
    for _, _, tag in sorted(a for a in asked if a[0]):
        for have in available:
            low = have.lower()
            if low in refused or low.split("-")[0] in refused or have in out:
                continue
            if tag == "*" or low == tag or low.split("-")[0] == tag.split("-")[0]:
                out.append(have)
    return [(x, i) for i, x in enumerate(out)]


def choose_display(designations: DataFrame, acceptability: DataFrame, ranks: list[tuple[str, int]], concepts: DataFrame | None = None) -> DataFrame:
    """(code, display): a preferred synonym of the best language's set, else any term of that language, else any; ties by id.

    Where designations (and concepts, if given) name a system, the result does, and codes are its own.
    """
    spark = designations.sparkSession
    order = spark.createDataFrame(ranks or [("", 0)], "language string, _rank int")
    preferred = acceptability.filter("acceptability = 'preferred'").select("designation_id", F.lit(0).alias("_own"))
    ranked = designations.filter("active").join(F.broadcast(order), "language", "left").join(preferred, "designation_id", "left")
    key = F.struct(F.coalesce("_rank", F.lit(len(ranks))), F.coalesce("_own", F.lit(1)), F.when(F.col("use_code") == "synonym", 0).otherwise(1), "designation_id")
    on = keys_of(designations) if concepts is None else keys_of(designations, concepts)
    best = ranked.groupBy(*on).agg(F.min_by("term", key).alias("term"))
    if concepts is None:
        return best.select(*on, F.col("term").alias("display"))
    return concepts.select(*on, "display").join(best, on, "left").select(*on, F.coalesce("term", "display").alias("display"))


# validation


def validate_codes(facts: DataFrame, concepts: DataFrame, systems: DataFrame, designations: DataFrame | None = None, lenient: bool = False, languages: list[str] | None = None) -> DataFrame:
    """facts with result, issues (array of severity, reason) and, where a display is asserted, its outcome among them.

    An unknown system, or one whose content cannot prove a code wrong, and an unknown code fail; an
    inactive code passes with a warning. Codes of case-blind systems are known in any case, with a note
    where the system writes them otherwise. Displays compare without regard to case; white space, a
    withdrawn term, or no term at all (of the languages, if any are asked for) are errors, or warnings
    if lenient; a code without any term of these languages passes with another's, with a note. Where
    concepts are intervals, facts may name a version; `release` tells the one that counts, and one that is not there is an error.
    """
    facts, systems, keys = _resolved(facts, concepts, systems)
    known = systems.select(*keys, F.col("content").alias("_content"))
    out = with_own(facts, concepts, systems, "active").join(known, keys, "left")
    absent = (F.col("release_error") == "unknown-version") if by_version(concepts) else F.lit(False)
    absent = F.coalesce(absent, F.lit(False))
    found, vague = F.col("_own").isNotNull(), F.col("_content").isin("fragment", "example", "not-present")
    issue = lambda severity, reason: F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
    checks = [
        F.when(absent, issue("error", "unknown-version")),
        F.when(F.col("_content").isNull() & ~absent, issue("error", "unknown-system")),
        F.when(F.col("_content").isNotNull() & ~found & vague, issue("warning", "unknown-code-in-fragment")),
        F.when(F.col("_content").isNotNull() & ~found & ~vague, issue("error", "unknown-code")),
        F.when(found & ~F.col("_own.active"), issue("warning", "inactive")),
        F.when(F.col("_own.code") != F.col("code"), issue("information", "case-differs")),
    ]
    if designations is not None and "display" in facts.columns:
        out = validate_display(out.withColumn("_code", F.coalesce("_own.code", "code")), designations, languages, "_code").drop("_code")
        severity = "warning" if lenient else "error"
        for reason in ("wrong-display", "white-space", "withdrawn-display"):
            checks.append(F.when(found & (F.col("display_outcome") == reason), issue(severity, reason)))
        checks.append(F.when(found & (F.col("display_outcome") == "other-language"), issue("information", "other-language")))
    out = out.withColumn("issues", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    passes = (found | F.coalesce(vague, F.lit(False))) & ~F.exists("issues", lambda x: x["severity"] == "error")
    return out.withColumn("result", passes).drop("_content", "_own", "release_no", "release_error")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def validate_display(facts: DataFrame, designations: DataFrame, languages: list[str] | None = None, code: str = "code") -> DataFrame:
    """facts (code, display, and system where designations have one) with display_outcome.

    It is none (no display), withdrawn-display, exact, white-space or wrong-display; with languages,
    only their terms and those of no language count for a code that has any, and a code that has none
    takes another's, as other-language. Terms meet facts on their folded text, so a code's many terms
    are not listed per fact.
    """
    on = keys_of(designations, facts)
    wanted = F.lit(True) if not languages or "*" in languages else F.col("language").isNull() | primary_language(F.col("language")).isin([x.lower().replace("_", "-").split("-")[0] for x in languages])
    terms = designations.select(*on, _squeezed(F.col("term")).alias("_squeezed"), F.lower("term").alias("_low"), "active", wanted.alias("_wanted"))
    own = F.col("active") & F.col("_wanted")
    texts = terms.groupBy(*on, "_squeezed").agg(F.collect_set(F.when(own, F.col("_low"))).alias("_exact"), F.max(own).alias("_fits"), F.max("active").alias("_current"), F.max(~F.col("active")).alias("_gone"))
    keyed = facts.withColumn("_squeezed", _squeezed(F.col("display")))
    named = {"code": code, "system": "system"}

    def met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"_r_{k}") for k in (*on, *more)], *[c for c in right.columns if c not in (*on, *more)])
        test = [F.col(named.get(k, k)) == F.col(f"_r_{k}") for k in (*on, *more)]
        return left.join(right, test, "left").drop(*[f"_r_{k}" for k in (*on, *more)])

    out = met(keyed, texts, "_squeezed")
    if languages:
        out = met(out, terms.groupBy(*on).agg(F.max(own).alias("_has")))
    other = (~F.coalesce("_has", F.lit(False)) & F.col("_current")) if languages else F.lit(False)
    outcome = (
        F.when(F.col("display").isNull(), "none").when(F.col("_gone"), "withdrawn-display").when(F.array_contains("_exact", F.lower("display")), "exact")
        .when(F.col("_fits"), "white-space").when(other, "other-language").otherwise("wrong-display")
    )
    return out.withColumn("display_outcome", outcome).drop("_squeezed", "_exact", "_fits", "_current", "_gone", "_has")


def validate_membership(facts: DataFrame, expansion: DataFrame, concepts: DataFrame, value_sets: DataFrame, active_only: bool = False, selectable_only: bool = False, systems: DataFrame | None = None) -> DataFrame:
    """facts (url, system, code) with result and reason.

    expansion is (url, system, code), at least of the codes that facts hold (valuesets.contains gives
    it without expanding the rest); value_sets (url) names those that exist; with systems, codes of
    case-blind ones are found in any case. Reasons: unknown-value-set, unknown-version (where concepts
    are intervals and facts name a version), unknown-code, inactive, abstract, not-in-value-set.
    """
    held = expansion.select("url", "system", F.col("code").alias("_code"), F.lit(True).alias("_in"))
    exists = value_sets.select("url", F.lit(True).alias("_set")).distinct()
    if by_version(concepts):
        facts, systems, _ = _resolved(facts, concepts, systems)
        out = with_own(facts, concepts, systems, "active", "abstract").drop("release_no", "release")
    elif systems is None:
        own = concepts.select("system", "code", F.struct("code", "active", "abstract").alias("_own"))
        out = facts.join(own, ["system", "code"], "left")
    else:
        out = with_own(facts, concepts, systems, "active", "abstract")
    out = out.withColumn("_code", F.col("_own.code")).join(exists, "url", "left").join(held, ["url", "system", "_code"], "left")
    absent = F.coalesce(F.col("release_error") == "unknown-version", F.lit(False)) if by_version(concepts) else F.lit(False)
    reason = (
        F.when(F.col("_set").isNull(), "unknown-value-set")
        .when(absent, "unknown-version")
        .when(F.col("_own").isNull(), "unknown-code")
        .when(F.col("_in").isNull(), "not-in-value-set")
        .when(F.lit(active_only) & ~F.col("_own.active"), "inactive")
        .when(F.lit(selectable_only) & F.col("_own.abstract"), "abstract")
    )
    return out.withColumn("reason", reason).withColumn("result", F.col("reason").isNull()).drop("_set", "_own", "_code", "_in", "release_error")


def validate_codeable(rows: DataFrame, row_key: str, validate) -> DataFrame:  # noqa: ANN001
    """One answer a row of codings (array<struct<system, code, ...>>): the first valid coding, and all issues.

    validate takes and returns a frame of codings with result and reason added.
    """
    spread = rows.select(row_key, F.posexplode("codings").alias("place", "c")).select(row_key, "place", "c.*")
    judged = validate(spread)
    first = F.min(F.when(F.col("result"), F.struct("place", "system", "code")))
    notes = F.sort_array(F.collect_list(F.when(~F.col("result"), F.struct("place", "reason"))))
    out = judged.groupBy(row_key).agg(first.alias("_first"), notes.alias("notes"))
    answer = rows.select(row_key).join(out, row_key, "left")
    return answer.select(row_key, F.col("_first").isNotNull().alias("result"), F.col("_first.system").alias("system"), F.col("_first.code").alias("code"), F.coalesce("notes", F.array().cast("array<struct<place:int,reason:string>>")).alias("notes"))


def infer_system(facts: DataFrame, expansion: DataFrame) -> DataFrame:
    """facts (url, code) with system and inferred: known where one system of the value set holds the code, else none or several."""
    held = expansion.join(facts.select("url", "code").distinct(), ["url", "code"], "left_semi").groupBy("url", "code").agg(F.count_distinct("system").alias("_n"), F.min("system").alias("_system"))
    out = facts.join(held, ["url", "code"], "left")
    n = F.coalesce("_n", F.lit(0))
    return out.withColumn("system", F.when(n == 1, F.col("_system"))).withColumn("inferred", F.when(n == 1, "known").when(n == 0, "none").otherwise("several")).drop("_n", "_system")


def validate_version(facts: DataFrame, used: DataFrame) -> DataFrame:
    """facts (system, version) with version_ok: the version fits one of the patterns that used (system, pattern) states; none asserted fits."""
    patterns = used.filter("pattern IS NOT NULL").groupBy("system").agg(F.collect_set("pattern").alias("_patterns"))
    out = facts.join(small(patterns), "system", "left")
    fits = F.exists("_patterns", lambda p: version_matches(F.col("version"), p))
    return out.withColumn("version_ok", F.col("version").isNull() | F.col("_patterns").isNull() | fits).drop("_patterns")


# translation

#: Relationships of a newer vocabulary and how an older one says them.
RELATIONSHIPS = {
    "equivalent": "equivalent",
    "equal": "equivalent",
    "wider": "source-is-narrower-than-target",
    "subsumes": "source-is-narrower-than-target",
    "broader": "source-is-narrower-than-target",
    "narrower": "source-is-broader-than-target",
    "specializes": "source-is-broader-than-target",
    "relatedto": "related-to",
    "inexact": "related-to",
    "unmatched": "no-map",
    "disjoint": "not-related-to",
}
# Relationships seen from the other side.
INVERSE = {"source-is-narrower-than-target": "source-is-broader-than-target", "source-is-broader-than-target": "source-is-narrower-than-target"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], c)


def relationship(c: Column) -> Column:
    """Either vocabulary as the newer one; anything else stays."""
    return _mapped(F.lower(c), RELATIONSHIPS)


def inverse(c: Column) -> Column:
    return _mapped(c, INVERSE)


def _source(facts: DataFrame, elements: DataFrame) -> list[Column]:
    """The source system of elements, as _source, where facts have a system to meet it."""
    return [F.col("source").alias("_source")] if "system" in facts.columns and "source" in elements.columns else []


def _meet(facts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """facts and rows by keys and, where rows have a _source, by the facts' system; rows without a source take any system. Codes that many systems share meet in their own system only."""
    if "_source" not in rows.columns:
        return facts.join(rows, keys)
    named = facts.join(rows.filter("_source IS NOT NULL").withColumnRenamed("_source", "system"), [*keys, "system"])
    return named.unionByName(facts.join(rows.filter("_source IS NULL").drop("_source"), keys))


def translate(facts: DataFrame, elements: DataFrame, name: str, target: str | None = None, version: str | None = None) -> DataFrame:
    """Every target of each fact's code in a map: facts' columns, target, target_code, relationship, no_map; none where no element matched.

    Where facts have a system, only elements of that source system count. A group's source_version and
    target_version, where elements have them, are told; version asks for one source_version.
    """
    rows = elements.filter(F.col("map") == name)
    rows = rows.filter(F.col("target") == target) if target else rows
    rows = rows.filter(F.col("source_version") == version) if version else rows
    versions = [c for c in ("source_version", "target_version") if c in rows.columns]
    rows = rows.select("code", *_source(facts, rows), "target", "target_code", relationship(F.col("relationship")).alias("relationship"), "no_map", *versions).distinct()
    return _meet(facts, rows, ["code"])


def translate_reverse(facts: DataFrame, elements: DataFrame, name: str) -> DataFrame:
    """Sources whose target is the fact's code (of the fact's system, where it has one), with the relationship turned round."""
    rows = elements.filter((F.col("map") == name) & F.col("target_code").isNotNull())
    side = [F.col("target").alias("_source")] if "system" in facts.columns and "target" in rows.columns else []
    rows = rows.select(F.col("target_code").alias("code"), *side, F.col("source").alias("target"), F.col("code").alias("_found"), inverse(relationship(F.col("relationship"))).alias("relationship")).distinct()
    return _meet(facts, rows, ["code"]).withColumnRenamed("_found", "target_code")


def _grouped(df: DataFrame) -> DataFrame:
    """df with group_no 0, no source, no target and no target_version where it lacks these columns."""
    null = F.lit(None).cast("string")
    for name, value in (("group_no", F.lit(0)), ("source", null), ("target", null), ("target_version", null)):
        df = df if name in df.columns else df.withColumn(name, value)
    return df


def _in_maps(facts: DataFrame, elements: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Matches of facts in their map (_map), and the rule of each group of it that found nothing; other_map where the rule passes on.

    Rules have one row a group of a map; they are broadcast where they are few.
    """
    rows, null = _grouped(elements), F.lit(None).cast("string")
    found = rows.select(F.col("map").alias("_map"), *_source(facts, rows), "code", "target", "target_version", "target_code", relationship(F.col("relationship")).alias("relationship"), "no_map").distinct()
    hit = _meet(facts, found, ["_map", "code"]).withColumn("other_map", null)
    groups = rows.groupBy("map", "group_no").agg(F.min("source").alias("_source"), F.min("target").alias("_target"), F.min("target_version").alias("_version"))
    rules = _grouped(unmapped).join(groups, ["map", "group_no"], "left").select(
        F.col("map").alias("_map"), F.col("group_no").alias("_group"), F.coalesce("source", "_source").alias("_source"), F.coalesce("target", "_target").alias("target"), F.coalesce("target_version", "_version").alias("target_version"),
        F.col("mode").alias("_mode"), F.col("fixed_code").alias("_fixed"), relationship(F.col("relationship")).alias("_rel"), F.when(F.col("mode") == "other-map", F.col("other_map")).alias("other_map"),
    ).filter("_mode IS NULL OR _mode != 'other-map' OR other_map IS NOT NULL").distinct()
    own = F.col("_source").isNull() | (F.col("_source") == F.col("system")) if "system" in facts.columns else F.lit(True)
    asked = facts.join(small(rules), "_map").filter(own)
    left = asked.join(rows.select(F.col("map").alias("_map"), F.col("group_no").alias("_group"), "code"), ["_map", "_group", "code"], "left_anti")
    same, fixed, on = F.col("_mode").isin("use-source-code", "provided"), F.col("_mode") == "fixed", F.col("_mode") == "other-map"
    refused = F.raise_error(F.concat(F.lit("unknown unmapped mode: "), F.coalesce("_mode", F.lit("none")))).cast("string")
    rest = left.select(
        *facts.columns, F.when(on, null).otherwise(F.col("target")).alias("target"), F.when(on, null).otherwise(F.col("target_version")).alias("target_version"), F.when(same, F.col("code")).when(fixed, F.col("_fixed")).when(on, null).otherwise(refused).alias("target_code"),
        F.when(same, F.coalesce("_rel", F.lit("equivalent"))).when(fixed, F.coalesce("_rel", F.lit("related-to"))).otherwise(F.col("_rel")).alias("relationship"), F.lit(False).alias("no_map"), "other_map",
    )
    return hit.unionByName(rest)


def translate_unmapped(facts: DataFrame, elements: DataFrame, unmapped: DataFrame, name: str) -> DataFrame:
    """Matches, and for facts that no element of a group matched the group's rule: the same code, a fixed one, or another map's name (other_map).

    Each group answers for itself, and, where facts have a system and the group a source, only for facts of that system.
    """
    return _in_maps(facts.withColumn("_map", F.lit(name)), elements.filter(F.col("map") == name), unmapped.filter(F.col("map") == name)).drop("_map")


def translate_chain(facts: DataFrame, elements: DataFrame, unmapped: DataFrame, name: str, depth: int = 8) -> DataFrame:
    """Translation that goes on in the other map where a group's rule says so; applied lists the maps used.

    Facts to be passed on more than depth times (as in a circle of maps), or to a map that does not exist, are an error.
    """
    done, left = None, facts.withColumn("_map", F.lit(name)).withColumn("_path", F.array().cast("array<string>"))
    maps = elements.select(F.col("map").alias("_map")).unionByName(unmapped.select(F.col("map").alias("_map"))).distinct()
    for _ in range(depth + 1):
        step = _in_maps(left, elements, unmapped).withColumn("_path", F.concat("_path", F.array("_map")))
        ready = step.filter("other_map IS NULL").drop("other_map", "_map").withColumnRenamed("_path", "applied")
        done = ready if done is None else done.unionByName(ready)
        left = cut(step.filter("other_map IS NOT NULL").select(*facts.columns, F.col("other_map").alias("_map"), "_path"), "chain")
        if left.isEmpty():
            return done
        unknown = left.select("_map").distinct().join(maps, "_map", "left_anti").first()
        if unknown:
            raise ValueError(f"an unmapped rule names a map that does not exist: {unknown[0]}")
    raise ValueError(f"unmapped rules pass codes on more than {depth} times, at {left.first()['_map']}")


def follow_maps(facts: DataFrame, elements: DataFrame, names: list[str]) -> DataFrame:
    """Targets of one map are the codes of the next; the last target_code and the number of steps."""
    keep = [c for c in facts.columns if c != "code"]
    out = facts.withColumn("start_code", F.col("code"))
    for name in names:
        out = translate(out, elements, name).filter("target_code IS NOT NULL").select(*keep, "start_code", F.col("target_code").alias("code")).distinct()
    return out


def in_scope(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """Facts whose code is in the map's source value set."""
    return facts.join(scope.select("system", "code"), ["system", "code"], "left_semi")


def translate_by_scope(facts: DataFrame, elements: DataFrame, scopes: DataFrame, held: DataFrame) -> DataFrame:
    """Targets of each fact in every map whose scopes hold the fact and the target: facts' columns, map, target, target_code, relationship, no_map.

    scopes (map, source_scope, target_scope) has a row a map; a null scope holds everything. held (url,
    system, code) tells what the scopes hold, at least of the codes of facts and of targets (valuesets.holding gives it for all
    scopes at once). A map's elements that name no source take any system. A stated no-map has no target to be held.
    """
    inside = held.select("url", "system", "code").distinct()
    rows = elements.select("map", "code", *_source(facts, elements), "target", "target_code", relationship(F.col("relationship")).alias("relationship"), "no_map").distinct()
    found = _meet(facts.select("system", "code").distinct(), rows, ["code"]).join(small(scopes.select("map", "source_scope", "target_scope")), "map")
    sources = inside.select(F.col("url").alias("source_scope"), "system", "code", F.lit(True).alias("_source_held"))
    aims = inside.select(F.col("url").alias("target_scope"), F.col("system").alias("target"), F.col("code").alias("target_code"), F.lit(True).alias("_target_held"))
    found = found.join(sources, ["source_scope", "system", "code"], "left").filter("source_scope IS NULL OR _source_held")
    found = found.join(aims, ["target_scope", "target", "target_code"], "left").filter("target_scope IS NULL OR target_code IS NULL OR _target_held")
    return facts.join(found.drop("_source_held", "_target_held", "source_scope", "target_scope"), ["system", "code"])


def translate_result(facts: DataFrame, key: str, matches: DataFrame) -> DataFrame:
    """One row a fact: result (some match relates) and reason (matched, explicit-no-map, unrelated, no-element)."""
    relates = ~F.coalesce(F.col("relationship").isin("no-map", "not-related-to"), F.lit(False)) & ~F.coalesce("no_map", F.lit(False)) & F.col("target_code").isNotNull()
    found = matches.groupBy(key).agg(F.bool_or(relates).alias("_any"), F.bool_or(F.coalesce("no_map", F.lit(False))).alias("_none"))
    reason = F.when(F.col("_any"), "matched").when(F.col("_none"), "explicit-no-map").when(F.col("_any").isNotNull(), "unrelated").otherwise("no-element")
    return facts.select(key).join(found, key, "left").select(key, F.coalesce("_any", F.lit(False)).alias("result"), reason.alias("reason"))


def successors(concepts: DataFrame, members: DataFrame, sets: list[str]) -> DataFrame:
    """(code, successor, refset_id): where inactive concepts' active association rows point."""
    rows = members.filter("active").filter(F.col("refset_id").isin(sets)).select("code", F.col("fields")["targetComponentId"].alias("successor"), "refset_id")
    return rows.filter("successor IS NOT NULL").join(concepts.filter("NOT active").select("code"), "code", "left_semi")


def refset_as_map(members: DataFrame, relationships: dict[str, str], target_field: str = "targetComponentId", target: str | dict[str, str] = "world", products: list[str] | None = None) -> DataFrame:
    """Association or map sets as map elements; relationships, and target systems where they differ, by set id; other fields as product. A set without a target system of its own keeps null."""
    table = F.create_map(*[F.lit(x) for kv in relationships.items() for x in kv])
    rows = members.filter("active").filter(F.col("refset_id").isin(list(relationships)))
    into = F.lit(target) if isinstance(target, str) else F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col("refset_id")]
    product = F.array(*[F.struct(F.lit(p).alias("property"), F.col("fields")[p].alias("value")) for p in products or []]) if products else F.array().cast("array<struct<property:string,value:string>>")
    return rows.select(
        F.col("refset_id").alias("map"), F.lit(0).alias("group_no"), "code", into.alias("target"), F.col("fields")[target_field].alias("target_code"),
        table[F.col("refset_id")].alias("relationship"), F.col("fields")[target_field].isNull().alias("no_map"), product.alias("product"),
    )


def map_rule_rows(members: DataFrame) -> DataFrame:
    """Rows of extended maps with their place inside (code, map_group) by priority."""
    f = lambda n: F.col("fields")[n]
    rows = members.filter("active").select(
        "refset_id", "code", f("mapGroup").cast("int").alias("map_group"), f("mapPriority").cast("int").alias("map_priority"), f("mapRule").alias("map_rule"),
        f("mapAdvice").alias("map_advice"), f("mapTarget").alias("map_target"), f("mapCategoryId").alias("map_category"),
    ).filter("map_group IS NOT NULL")
    order = Window.partitionBy("refset_id", "code", "map_group").orderBy("map_priority", "map_target")
    return rows.withColumn("place", F.row_number().over(order))


def languages_of(designations: DataFrame) -> DataFrame:
    return designations.select(primary_language(F.col("language")).alias("language")).distinct()
