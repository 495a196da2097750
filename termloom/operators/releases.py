"""Versions, layers, supplements and the quality of releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.versions import version_key, version_matches

# versions


def order_versions(versions: DataFrame) -> DataFrame:
    """(url, version) with `place`, from 1, in segment-wise order inside each url."""
    order = Window.partitionBy("url").orderBy(version_key(F.col("version")), "version")
    return versions.withColumn("place", F.row_number().over(order))


def resolve_version(asked: DataFrame, versions: DataFrame, defaults: DataFrame | None = None, kind: str = "value-set") -> DataFrame:
    """asked (url, wanted) with `resolved`: exact, else greatest match of a pattern, else the default (nothing wanted), else the greatest.

    Code systems take the greatest version string, value sets and maps the numeric-aware greatest.
    A version that is wanted and fits nothing resolves to null.
    """
    key = F.array("version") if kind == "code-system" else version_key(F.col("version"))
    keyed = versions.select("url", "version", key.alias("_key"))
    wants = asked.select("url", "wanted").distinct()
    if defaults is not None:
        wants = wants.join(defaults.select("url", "default_version"), "url", "left")
    else:
        wants = wants.withColumn("default_version", F.lit(None).cast("string"))
    met = wants.join(keyed, "url", "left")
    fits = F.when(F.col("wanted").isNotNull(), version_matches(F.col("version"), F.col("wanted"))).otherwise(F.lit(True))
    found = met.groupBy("url", "wanted", "default_version").agg(
        F.max(F.when(F.col("version") == F.col("wanted"), F.col("version"))).alias("_exact"), F.max_by(F.when(fits, F.col("version")), F.when(fits, F.col("_key"))).alias("_best"),
    )
    resolved = F.coalesce("_exact", F.when(F.col("wanted").isNull(), F.col("default_version")), "_best")
    return found.select("url", "wanted", resolved.alias("resolved"))


def layer(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key: that of the highest layer that has it (the last in the list); of several there that of the greatest text, so that reruns agree."""
    ranked = [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)]
    everything = ranked[0]
    for df in ranked[1:]:
        everything = everything.unionByName(df, allowMissingColumns=True)
    rest = [c for c in everything.columns if c not in (*keys, "_layer")]
    best = everything.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_layer", F.to_json(F.struct(*rest)))).alias("_best")) if rest else everything.select(*keys).distinct()
    return best.select(*keys, "_best.*") if rest else best


def apply_supplement(designations: DataFrame, properties: DataFrame, extra_terms: DataFrame, extra_properties: DataFrame, known: DataFrame | None = None, asked: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Designations and properties with those of supplements (rows with supplement_url); an asked one that is not known is an error."""
    if asked and known is not None:
        missing = set(asked) - {r[0] for r in known.filter(F.col("supplement_url").isin(asked)).select("supplement_url").distinct().collect()}
        if missing:
            raise ValueError(f"unknown supplements {sorted(missing)}")
    pick = (lambda df: df.filter(F.col("supplement_url").isin(asked))) if asked else (lambda df: df)
    return (
        designations.unionByName(pick(extra_terms).drop("supplement_url"), allowMissingColumns=True),
        properties.unionByName(pick(extra_properties).drop("supplement_url"), allowMissingColumns=True),
    )


# quality


def _findings(listed: DataFrame, release: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """listed (system, code, and others) of systems that the release has, with finding; rows without one are left out."""
    now = release.select("system", "code", F.col("active").alias("_active"))
    served = listed.join(release.select("system").distinct(), "system", "left_semi").join(now.hint("merge"), ["system", "code"], "left")  # whole releases: not for the driver
    if inside is not None:
        served = served.join(inside.select("url", "system", "code", F.lit(True).alias("_in")).distinct().hint("merge"), ["url", "system", "code"], "left")
    out = F.col("_in").isNull() if inside is not None else F.lit(False)
    finding = F.when(F.col("_active").isNull(), "unknown").when(out, "outside").when(~F.col("_active"), "inactive")
    return served.withColumn("finding", finding).filter("finding IS NOT NULL").drop("_active", "_in")


def revalidate_value_sets(rules: DataFrame, release: DataFrame, release_name: str, expansion: DataFrame | None = None) -> DataFrame:
    """Listed codes that the release does not know or has made inactive, or that their value set no longer holds: url, code, finding, release.

    The finding is unknown, outside or inactive, the first that fits. outside needs the expansion (url, system, code) of
    the value sets over the release: a listed code may fail the set's excludes, filters or references.
    """
    listed = rules.filter("code IS NOT NULL").filter(F.col("side") == "include") if "side" in rules.columns else rules.filter("code IS NOT NULL")
    found = _findings(listed.select("url", "system", "code").distinct(), release, expansion)
    return found.select("url", "system", "code", "finding", F.lit(release_name).alias("release"))


def revalidate_maps(elements: DataFrame, release: DataFrame, release_name: str) -> DataFrame:
    """The same for both sides of every map: map, side, code, finding, release. elements name source_system and target_system."""
    sides = elements.select("map", F.lit("source").alias("side"), F.col("source_system").alias("system"), "code").unionByName(
        elements.filter("target_code IS NOT NULL").select("map", F.lit("target").alias("side"), F.col("target_system").alias("system"), F.col("target_code").alias("code"))
    )
    return _findings(sides.distinct(), release).select("map", "side", "system", "code", "finding", F.lit(release_name).alias("release"))


def feed_select(offered: DataFrame, subscribed: DataFrame, held: DataFrame, categories: list[str]) -> DataFrame:
    """offered (id, category, version, date, content_link) with `taken` and `reason`; the first reason to skip counts."""
    out = offered.join(subscribed.select("id", F.lit(True).alias("_sub")).distinct(), "id", "left").join(held.groupBy("id").agg(F.max("date").alias("_held")), "id", "left")
    reason = (
        F.when(~F.col("category").isin(categories), "category")
        .when(F.col("_sub").isNull(), "not-subscribed")
        .when(F.col("content_link").isNull(), "no-content")
        .when(F.col("date") <= F.col("_held"), "not-newer")
    )
    return out.withColumn("reason", reason).withColumn("taken", F.col("reason").isNull()).drop("_sub", "_held")


def feed_unseen(subscribed: DataFrame, offered: DataFrame) -> DataFrame:
    return subscribed.select("id").distinct().join(offered.select("id"), "id", "left_anti")


def retain_releases(releases: DataFrame, keep: int) -> DataFrame:
    """The newest releases of each system by (date, version); 0 keeps all."""
    if keep == 0:
        return releases
    order = Window.partitionBy("system").orderBy(F.col("date").desc(), F.col("version").desc())
    return releases.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def duplicate_resources(resources: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return resources.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges with an end that is no concept: child, parent, missing."""
    known = concepts.select("code")
    lost = edges.join(known.withColumnRenamed("code", "parent"), "parent", "left_anti").select("child", "parent", F.lit("parent").alias("missing"))
    return lost.unionByName(edges.join(known.withColumnRenamed("code", "child"), "child", "left_anti").select("child", "parent", F.lit("child").alias("missing")))


def system_stats(tables: dict[str, DataFrame], distinct: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(name, n): rows of each table, and distinct values of (table, column) under further names; one aggregation a table."""
    out = None
    for name, df in tables.items():
        own = {k: c for k, (t, c) in (distinct or {}).items() if t == name}
        row = df.agg(F.count(F.lit(1)).alias(name), *[F.count_distinct(c).alias(k) for k, c in own.items()])
        long = row.unpivot([], [name, *own], "name", "n")
        out = long if out is None else out.unionByName(long)
    return out


def definition_diff(old: DataFrame, new: DataFrame, keys: list[str], ignore: list[str] | None = None) -> DataFrame:
    """keys, change (added, removed, changed) and the names of the columns that differ, null-safe; columns in ignore do not count."""
    values = [c for c in old.columns if c not in keys and c not in (ignore or [])]
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in values], F.lit(True).alias(f"_{s}"))
    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    fields = F.filter(F.array(*[F.when(~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new")), F.lit(c)) for c in values]), lambda x: x.isNotNull())
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return both.withColumn("change", change).withColumn("fields", F.when(F.col("change") == "changed", fields)).filter("change IS NOT NULL").select(*keys, "change", "fields")


def snapshot_from_full(full: DataFrame, key: str, as_of: int, time: str = "effective_time", released: str | None = None) -> DataFrame:
    """Of every id the latest row up to a date; of several of one time that of the greatest text, so that reruns agree. as_of bounds `released`, where that is another column than the time rows are ordered by."""
    rest = [c for c in full.columns if c != key]
    order = F.struct(F.col(time), F.to_json(F.struct(*rest)))
    return full.filter(F.col(released or time) <= as_of).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def release_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(code, change) between concepts (code, active, parents, display) of two releases: added, removed, retired, revived, moved, renamed."""
    diff = definition_diff(old, new, ["code"])
    now = new.select("code", F.col("active").alias("_active"))
    named = diff.join(now, "code", "left")
    kinds = F.when(F.col("change") != "changed", F.array("change")).otherwise(
        F.filter(
            F.array(
                F.when(F.array_contains("fields", "active"), F.when(F.col("_active"), "revived").otherwise("retired")),
                F.when(F.array_contains("fields", "parents"), "moved"), F.when(F.array_contains("fields", "display"), "renamed"),
            ), lambda x: x.isNotNull(),
        )
    )
    return named.select("code", F.explode(kinds).alias("change"))
