"""Several versions of a system side by side: releases by number, contents as intervals of releases.

releases are systems (system, version, case_sensitive, content) with release_no, which counts a system's versions
upwards. Contents (system, version, ...) are kept once for each run of releases in which they do not change, with from_no and
to_no; a fact, or a rule, whose version has been resolved to a number meets the one interval that holds it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.versions import version_key, version_matches
from termloom.operators import hierarchy as H
from termloom.operators import valuesets as VS
from termloom.operators.codes import code_key
from termloom.tables import cut, small


def number_releases(systems: DataFrame) -> DataFrame:
    """systems (system, version, ...) with release_no: 1, 2, ... in the order of versions inside each system."""
    order = Window.partitionBy("system").orderBy(version_key(F.col("version")), "version")
    return systems.withColumn("release_no", F.row_number().over(order))


def intervals(contents: DataFrame, releases: DataFrame) -> DataFrame:
    """contents (system, version, any columns) without version, with from_no and to_no: a row each time that a row is there in successive releases."""
    keys = [c for c in contents.columns if c != "version"]
    rows = contents.distinct().join(small(releases.select("system", "version", "release_no")), ["system", "version"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("release_no"))
    return rows.withColumn("_run", F.col("release_no") - place).groupBy(*keys, "_run").agg(F.min("release_no").alias("from_no"), F.max("release_no").alias("to_no")).drop("_run")


def code_intervals(concepts: DataFrame, releases: DataFrame) -> DataFrame:
    """concepts (system, version, code, ...) as (system, key, code, ..., from_no, to_no).

    key is the code as its system compares it. The intervals of one key do not overlap: of codes that
    differ in case alone in a case-blind release, the least stands for all.
    """
    columns = [c for c in concepts.columns if c not in ("system", "version")]
    rows = concepts.join(small(releases.select("system", "version", "release_no", "case_sensitive")), ["system", "version"])
    rows = rows.withColumn("key", code_key(F.col("code"), F.col("case_sensitive"))).repartition("system", "key")  # all that follows stays where a key is
    keyed = rows.groupBy("system", "key", "release_no").agg(F.min(F.struct("code", *[c for c in columns if c != "code"])).alias("own"))
    by = Window.partitionBy("system", "key").orderBy("release_no")
    goes_on = F.lag("own").over(by).eqNullSafe(F.col("own")) & (F.lag("release_no").over(by) == F.col("release_no") - 1)
    runs = keyed.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy("system", "key", "_run").agg(F.first("own").alias("own"), F.min("release_no").alias("from_no"), F.max("release_no").alias("to_no")).select("system", "key", "own.*", "from_no", "to_no")


def resolve_releases(facts: DataFrame, releases: DataFrame, version: str = "version") -> DataFrame:
    """facts (system and, perhaps, a version column) with release_no, release (its version) and release_error.

    A version may be a pattern, with x for any segment; of the versions that fit, and where none is
    named, the greatest counts. release_error is unknown-system or unknown-version; rows without a system get neither.
    Each (system, version) that facts name is resolved once; facts keep their number.
    """
    named = facts if version in facts.columns else facts.withColumn(version, F.lit(None).cast("string"))
    asked = named.select(F.col("system").alias("_system"), F.col(version).alias("_asked")).distinct()
    known = releases.select(F.col("system").alias("_of"), F.col("version").alias("_version"), "release_no")
    fits = F.col("_asked").isNull() | version_matches(F.col("_version"), F.col("_asked"))
    best = F.max(F.when(F.coalesce(fits, F.lit(False)) & F.col("_of").isNotNull(), F.struct("release_no", F.col("_version").alias("release"))))
    found = asked.join(small(known), F.col("_system") == F.col("_of"), "left").groupBy("_system", "_asked").agg(best.alias("_best"), F.max(F.col("_of").isNotNull()).alias("_there"))
    out = named.join(small(found), F.col("system").eqNullSafe(F.col("_system")) & F.col(version).eqNullSafe(F.col("_asked")), "left")
    error = F.when(F.col("system").isNull(), None).when(~F.col("_there"), "unknown-system").when(F.col("_best").isNull(), "unknown-version")
    out = out.withColumns({"release_no": F.col("_best.release_no"), "release": F.col("_best.release"), "release_error": error}).drop("_system", "_asked", "_best", "_there")
    return out if version in facts.columns else out.drop(version)


def held_at(contents: DataFrame, asked: DataFrame) -> DataFrame:
    """contents (system, ..., from_no, to_no) as of each release in asked (system, release_no, key): system becomes the release's key.

    Contents without from_no and to_no hold for all releases of their system.
    """
    rest = [c for c in contents.columns if c not in ("system", "from_no", "to_no")]
    named = asked.select(F.col("system").alias("_of"), F.col("release_no").alias("_no"), F.col("key").alias("_as"))
    on = F.col("system") == F.col("_of")
    if "from_no" in contents.columns:
        on = on & F.col("_no").between(F.col("from_no"), F.col("to_no"))
    return contents.join(named, on).select(F.col("_as").alias("system"), *rest)


def expand_versions(rules: DataFrame, t: VS.SystemTables, releases: DataFrame, **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """Expansions (url, system, version, code, display, ...) of rules that may name versions, and the rules that name none that is there.

    A rule's version is its `resolved` one (see pin_versions) where rules have that column and it is set, else system_version; patterns and
    the greatest version count as in resolve_releases. The tables of t hold intervals; those without
    hold for all releases. A code counts in the version that its rule resolves to: rules of one value set that
    draw on two versions give both, and conditions of one rule (references too) meet inside a version only. Only the releases that rules resolve to are
    looked at, each once, whatever the number of rules. The second result is url, side, rule_no, system,
    system_version, error; these rules take no part.
    """
    wanted = F.coalesce(F.when(F.col("ref_url").isNull(), F.col("resolved")), F.col("system_version")) if "resolved" in rules.columns else F.col("system_version")
    named = cut(resolve_releases(rules.withColumn("system_version", wanted).select(*[f.split()[0] for f in VS.RULES.split(", ")]), releases, "system_version"), "rules-resolved")
    rule = ["url", "side", "rule_no"]
    errors = named.filter("release_error IS NOT NULL").select(*rule, "system", "system_version", F.col("release_error").alias("error")).distinct()
    good = named.join(errors.select(*rule), rule, "left_anti")
    key = F.concat_ws("|", "system", "release")
    asked = small(cut(good.filter("system IS NOT NULL").select("system", "release_no", "release", key.alias("key")).distinct(), "releases-asked"))
    at = lambda df: None if df is None else held_at(df, asked)
    edges, concepts = cut(at(t.edges), "edges-asked"), cut(at(t.concepts), "concepts-asked")  # read again by each step of an expansion

    def closure() -> DataFrame:
        inside = lambda c: F.concat_ws("\u0001", "system", c)  # noqa: E731  the nodes of one release are its own
        reach = H.transitive_closure(edges.select(inside("child").alias("child"), inside("parent").alias("parent")))
        part = lambda c, i: F.get(F.split(c, "\u0001"), F.lit(i))
        return reach.select(part("descendant", 0).alias("system"), part("descendant", 1).alias("descendant"), part("ancestor", 1).alias("ancestor"), "min_depth")

    systems = releases.join(asked.select("system", "release_no", "key"), ["system", "release_no"]).select(F.col("key").alias("system"), "version", "case_sensitive", "content")
    tables = replace(t, concepts=concepts, edges=edges, closure=closure, properties=at(t.properties), systems=systems, members=at(t.members), sets=at(t.sets), designations=at(t.designations), only=at(t.only))
    keyed = good.withColumn("system", F.when(F.col("system").isNotNull(), key)).drop("release", "release_no", "release_error")
    out = VS.expand(keyed, tables, **options).withColumnRenamed("system", "key").join(asked, "key")
    return out.select("url", "system", F.col("release").alias("version"), *[c for c in out.columns if c not in ("url", "key", "system", "release", "release_no")]), errors
