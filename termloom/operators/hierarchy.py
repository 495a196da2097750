"""Hierarchies: closure, cycles, reach, subsumption, roll-up, pages and closure tables.

edges are (child, parent); a closure is (descendant, ancestor, min_depth) without the node itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.tables import BROADCAST_ROWS, cut, new_path


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All (descendant, ancestor, min_depth) by path doubling: rounds grow with the logarithm of the depth.

    When all pairs up to a depth d are known, every pair up to 2d goes through a node just d above
    its descendant, so only the pairs of depth d meet the known ones, and only what is new is
    written. Where nothing lies above these pairs, no further round is begun. A node on a cycle reaches itself; such pairs are left out (see detect_cycles).
    """
    spark, folder = edges.sparkSession, new_path(edges.sparkSession, "closure")
    new = edges.filter("child IS NOT NULL AND parent IS NOT NULL AND child != parent").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct().withColumn("min_depth", F.lit(1))
    schema = new.schema

    def read(*rounds: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in rounds])

    for i in range(max_rounds):
        new.write.parquet(f"{folder}/{i}")
        known = read(*range(i + 1))
        if read(i).isEmpty():
            break
        first = read(i).filter(F.col("min_depth") == 2**i).select("descendant", F.col("ancestor").alias("_via"))
        upper = known.select(F.col("descendant").alias("_via"), "ancestor", "min_depth")
        vias = first.select("_via").distinct()
        if vias.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # few codes in the middle, as high up: only what lies above them meets the pairs below
            upper = cut(upper.join(F.broadcast(vias), "_via", "left_semi"), "closure-upper")
            rows = upper.count()
            if not rows:
                break
            upper = F.broadcast(upper) if rows <= BROADCAST_ROWS else upper.hint("merge")
        longer = first.join(upper, "_via").filter("descendant != ancestor").groupBy("descendant", "ancestor").agg((F.min("min_depth") + 2**i).cast("int").alias("min_depth"))
        new = longer.join(known, ["descendant", "ancestor"], "left_anti")
    return known


#: Levels that `reached` walks; what is deeper is for a closure, whose rounds grow with the logarithm of the depth.
LEVELS = 16


def reached(starts: DataFrame, edges: DataFrame, up: bool = False) -> DataFrame | None:
    """(start, code, and system where both name it): what lies below (or above, with up) each of starts (code), without the start itself.

    A walk from the starts, level by level: only what they reach moves, where a closure has a row for each pair of all codes.
    A code that a start has reached is not walked from again. None, where more than LEVELS levels lie below.
    """
    spark, folder = edges.sparkSession, new_path(edges.sparkSession, "reached")
    place = [c for c in ("system",) if c in starts.columns and c in edges.columns]
    here, there = ("child", "parent") if up else ("parent", "child")
    steps = edges.filter("child IS NOT NULL AND parent IS NOT NULL AND child != parent").select(*place, F.col(here).alias("_at"), F.col(there).alias("code"))
    key = [*place, "start", "code"]
    new = starts.filter("code IS NOT NULL").select(*place, F.col("code").alias("start"), "code").distinct()
    schema = new.schema
    for i in range(LEVELS + 2):
        new.write.parquet(f"{folder}/{i}")
        known, level = (spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in rounds]) for rounds in (range(i + 1), [i]))
        rows = level.count()
        if not rows:
            return known.filter("code != start")
        level = level.select(*place, "start", F.col("code").alias("_at"))
        level = F.broadcast(level) if rows <= BROADCAST_ROWS else level.hint("merge")
        new = steps.join(level, [*place, "_at"]).select(key).distinct().join(known.hint("merge"), key, "left_anti")
    return None


def detect_cycles(edges: DataFrame) -> DataFrame:
    """(node): what is left when nodes without a remaining parent are peeled off again and again: nodes on or below a cycle.

    Two levels are peeled off a round.
    """

    def peeled(left: DataFrame) -> DataFrame:
        return left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")

    left = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "peel")
    rows = left.count()
    while rows:
        left = cut(peeled(peeled(left)), "peel", instead_of=left)
        before, rows = rows, left.count()
        if rows == before:
            break
    return left.select(F.col("child").alias("node")).distinct()


def roots(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    return concepts.select("code").join(edges.select(F.col("child").alias("code")), "code", "left_anti")


def leaves(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    return concepts.select("code").join(edges.select(F.col("parent").alias("code")).distinct(), "code", "left_anti")  # of a parent with many children one row moves


def children(codes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(codes.select(F.col("code").alias("parent")), "parent", "left_semi").select(F.col("child").alias("code")).distinct()


def parents(codes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(codes.select(F.col("code").alias("child")), "child", "left_semi").select(F.col("parent").alias("code")).distinct()


def descendants(codes: DataFrame, closure: DataFrame, or_self: bool = False) -> DataFrame:
    found = closure.join(codes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("code"))
    return (found.unionByName(codes.select("code")) if or_self else found).distinct()


def below(codes: DataFrame, edges: DataFrame, closure: Callable[[], DataFrame]) -> DataFrame:
    """descendants, by a walk from the codes; the closure is asked for only where many levels lie below them."""
    walked = reached(codes, edges)
    return descendants(codes, closure()) if walked is None else walked.select("code").distinct()


def ancestors(codes: DataFrame, closure: DataFrame, or_self: bool = False) -> DataFrame:
    found = closure.join(codes.select(F.col("code").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("code"))
    return (found.unionByName(codes.select("code")) if or_self else found).distinct()


def any_parent_in(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of codes with a parent that is also one of them."""
    inside = edges.join(codes.select(F.col("code").alias("parent")), "parent", "left_semi").select(F.col("child").alias("code"))
    return codes.select("code").join(inside, "code", "left_semi")


def descendant_leaves(codes: DataFrame, closure: DataFrame, edges: DataFrame) -> DataFrame:
    return descendants(codes, closure).join(edges.select(F.col("parent").alias("code")), "code", "left_anti")


def subsumes_pairs(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """pairs (a, b, optionally system_a, system_b and version_a, version_b) with `outcome`; two systems, or two versions of one, are refused."""
    up = closure.select(F.col("descendant").alias("b"), F.col("ancestor").alias("a"), F.lit(True).alias("_ab"))
    down = closure.select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("_ba"))
    differ = [F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False)) for c in ("system", "version") if f"{c}_a" in pairs.columns]
    refused = reduce(lambda x, y: x | y, differ, F.lit(False))
    outcome = F.when(refused, "refused").when(F.col("a") == F.col("b"), "equivalent").when(F.col("_ab"), "subsumes").when(F.col("_ba"), "subsumed-by").otherwise("not-subsumed")
    return pairs.join(up, ["a", "b"], "left").join(down, ["a", "b"], "left").withColumn("outcome", outcome).drop("_ab", "_ba")


def rollup_counts(facts: DataFrame, closure: DataFrame, code: str, measures: dict[str, Column]) -> DataFrame:
    """Facts at every ancestor of their code and at the code itself.

    Measures must be sums, counts, minima or maxima of columns: facts are first aggregated to one
    row a code, so that only codes, not facts, meet the closure. measures maps a name to the column
    whose sum is wanted; n counts facts.
    """
    per_code = facts.groupBy(code).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in measures.items()])
    up = closure.select(F.col("descendant").alias(code), "ancestor")
    spread = per_code.join(up, code).drop(code).withColumnRenamed("ancestor", "code").unionByName(per_code.withColumnRenamed(code, "code"))
    return spread.groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in measures])


def preorder(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, depth, path, loose): the set as a forest, children under their parents in code order, each code at its first visit.

    The path of codes from a root of the set sorts as the walk does; of several paths the least is
    the first visit, so of those of one length only the least goes on. Members that no root reaches
    (circles) are loose: they come after the others, at depth 0.
    """
    return _forest(codes, edges).drop("inner")


def _forest(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """preorder, and whether a code is inner, a parent inside the set. Only inner codes are walked on from."""
    everyone, spark = codes.select("code").distinct(), codes.sparkSession
    heads = cut(edges.select(F.col("parent").alias("code")).distinct().join(codes.select("code"), "code", "left_semi"), "forest-parents")
    side = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads.hint("merge")
    inside = edges.join(side.select(F.col("code").alias("parent")), "parent").select(F.col("child").alias("code"), "parent")
    family = everyone.join(inside.hint("merge"), "code", "left").join(side.select("code", F.lit(True).alias("inner")), "code", "left")
    family = cut(family.select("code", "parent", F.coalesce("inner", F.lit(False)).alias("inner")).distinct(), "forest")
    level, folder, i = family.filter("parent IS NULL").select("code", "inner", F.array("code").alias("path")), new_path(spark, "walk"), 0
    inside, schema = family.filter("parent IS NOT NULL"), level.schema
    while True:
        level.write.parquet(f"{folder}/level={i}")
        level = spark.read.schema(schema).parquet(f"{folder}/level={i}").filter("inner")
        rows = level.count()
        if not rows:
            break
        level = level.groupBy(F.col("code").alias("parent")).agg(F.min("path").alias("path"))
        level = F.broadcast(level) if rows <= BROADCAST_ROWS else level.hint("merge")
        longer = inside.join(level, "parent").filter(~F.array_contains("path", F.col("code")))
        level, i = longer.select("code", "inner", F.concat("path", F.array("code")).alias("path")), i + 1
    kind = schema["path"].dataType
    visits = spark.read.schema(schema).parquet(folder).select("code", "inner", "path").unionByName(everyone.select("code", F.lit(False).alias("inner"), F.lit(None).cast(kind).alias("path")))
    first = visits.groupBy("code").agg(F.min("path").alias("path"), F.max("inner").alias("inner"))
    return first.select("code", (F.size(F.coalesce("path", F.array("code"))) - 1).alias("depth"), F.coalesce("path", F.array("code")).alias("path"), F.col("path").isNull().alias("loose"), "inner")


def _ranged(df: DataFrame, by: list[Column], ordered: bool = False) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]], int]:
    """df dealt out by ranges of its order (with _part; ordered: also sorted, with _row, from 0 in each range), the first place of each range (_part, _first), the ranges (part, first, rows), and all rows."""
    dealt = df.repartitionByRange(*by)
    if ordered:  # ids are the partition, and the row in it
        dealt = dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
        dealt = dealt.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND(F.lit(2**33 - 1))}).drop("_id")
    ranged = cut(dealt if ordered else dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):  # a row a partition
        sizes.append((part, total, n))
        total += n
    firsts = df.sparkSession.createDataFrame([x[:2] for x in sizes], "_part int, _first long")
    return ranged, firsts, sizes, total


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with its place (from 0) in the order given, which must tell all rows apart; ranges of the order are sorted and numbered side by side, as they are written."""
    ranged, firsts, _, _ = _ranged(df, by, ordered=True)
    return ranged.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_row") + F.col("_first")).drop("_part", "_first", "_row")


def page(ordered: DataFrame, by: list[Column], offset: int, count: int) -> DataFrame:
    """Rows offset.. of count by the order given, with `place` (from 0) and `total`. Only the ranges of the order that hold the page are sorted, however deep it lies."""
    ranged, firsts, sizes, total = _ranged(ordered, by)
    wanted = [part for part, first, n in sizes if first < offset + count and first + n > offset]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    placed = ranged.filter(F.col("_part").isin(wanted)).withColumn("place", within).join(F.broadcast(firsts), "_part").withColumn("place", F.col("place") + F.col("_first"))
    return placed.filter((F.col("place") >= offset) & (F.col("place") < offset + count)).withColumn("total", F.lit(total).cast("long")).drop("_part", "_first")


def preorder_page(codes: DataFrame, edges: DataFrame, offset: int, count: int) -> DataFrame:
    return page(preorder(codes, edges), [F.col("loose"), F.col("path")], offset, count).select("place", "code", "depth", "total")


# Interval labels: a code's tree interval holds the numbers of what lies below it in the walk; what is
# reached by other parents only adds further intervals.

#: Numbers of one bin of the range test.
BIN = 4_096


def _places(codes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels (code, place, last, path) and the walk (code, path, loose, inner, place). Only inner codes meet the number of codes below them; all others end where they begin."""
    walk = numbered(_forest(codes, edges), [F.col("loose"), F.col("path")], "place")
    below = walk.filter("NOT loose").select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("size"))
    inner = walk.filter("inner").select("code", "place", "path").join(below, "code", "left")
    inner = cut(inner.select("code", "place", (F.col("place") + F.coalesce("size", F.lit(0))).alias("last"), "path"), "inner-labels")
    return walk.filter("NOT inner").select("code", "place", F.col("place").alias("last"), "path").unionByName(inner), walk


def preorder_numbers(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, place, last): each code's place in the preorder walk, and the greatest place below it."""
    return _places(codes, edges)[0].drop("path")


def interval_labels(codes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels (code, place, last) and cover (code, low, high): a code is b or below b if its place is in one of b's intervals.

    place numbers the preorder walk and last is the greatest place below a code in it. A code with
    several parents is walked below one of them; the others, and all that reach them, get the
    code's interval too, unless they hold it already. Intervals that lie in or next to each other become one.
    Tests of subsumption are then range tests, without a closure, which has a row a pair. Codes on a circle, which no root
    reaches, are below each other, and so below themselves.
    """
    labels, walk = _places(codes, edges)
    inside = edges.select("child", "parent").distinct().filter("child != parent")
    at = lambda side, *more: labels.select(F.col("code").alias(side), *more)
    tree_parent = F.get("path", F.size("path") - 2)
    # ways beside the tree: only codes of several parents, or on no tree, have them
    several = inside.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.collect_list("parent").alias("_all"))
    several = several.join(walk.filter("loose").select(F.col("code").alias("child"), "loose"), "child", "left").filter("n > 1 OR loose").select("child", F.explode("_all").alias("parent"))
    others = several.join(at("child", tree_parent.alias("_own")), "child").filter("_own IS NULL OR _own != parent").select("child", "parent")
    direct = cut(others.join(at("parent", "path"), "parent").select(F.explode("path").alias("code"), "child").distinct(), "label-entries")
    entries = direct.select(F.col("child").alias("code")).distinct()
    links = direct.join(entries, "code", "left_semi").select(F.col("child").alias("parent"), F.col("code").alias("child"))
    further = transitive_closure(links).select(F.col("descendant").alias("child"), F.col("ancestor").alias("_next"))
    reached = direct.unionByName(direct.join(further, "child").select("code", F.col("_next").alias("child"))).distinct()
    spans = labels.select("code", F.col("place").alias("low"), F.col("last").alias("high"))
    extra = reached.join(labels.select(F.col("code").alias("child"), F.col("place").alias("low"), F.col("last").alias("high")), "child").join(labels.select("code", "place", "last"), "code")
    extra = extra.filter("low < place OR high > last").select("code", "low", "high")
    by = Window.partitionBy("code").orderBy("low", F.col("high").desc())
    seen = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.unionByName(extra).withColumn("_new", F.coalesce((F.col("low") > seen + 1).cast("int"), F.lit(1)))
    cover = runs.withColumn("_run", F.sum("_new").over(by)).groupBy("code", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")
    return labels.select("code", "place", "last"), cover


def subsumes_by_labels(pairs: DataFrame, labels: DataFrame, cover: DataFrame) -> DataFrame:
    """pairs (a, b) with `outcome`, as subsumes_pairs, from interval_labels.

    Both codes take their tree interval once, which answers for all codes without further intervals. Only pairs with a code
    that has such are asked again: their intervals meet places by code and bin, so that a code of many intervals is not read through for a pair.
    """
    own = labels.select("code", F.col("place").alias("low"), F.col("last").alias("high"))
    further = cut(cover.join(own, ["code", "low", "high"], "left_anti"), "label-further")
    wide = further.select("code").distinct().withColumn("_wide", F.lit(True))
    known = cut(labels.join(wide, "code", "left").select("code", "place", "last", F.coalesce("_wide", F.lit(False)).alias("wide")), "labels-known")
    at = lambda side: known.select(F.col("code").alias(side), F.struct("place", "last", "wide").alias(f"_{side}"))
    held = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    within = lambda one, other: F.coalesce(F.col(f"_{one}.place").between(F.col(f"_{other}.place"), F.col(f"_{other}.last")), F.lit(False))
    more = lambda one, other: F.coalesce(F.col(f"_{other}.wide") & F.col(f"_{one}.place").isNotNull(), F.lit(False))
    held = held.select(*pairs.columns, within("b", "a").alias("_ab"), within("a", "b").alias("_ba"), F.when(more("b", "a"), F.col("_b.place")).alias("_b_in_a"), F.when(more("a", "b"), F.col("_a.place")).alias("_a_in_b"))
    held = cut(held.withColumn("_open", (F.col("_b_in_a").isNotNull() & ~F.col("_ab")) | (F.col("_a_in_b").isNotNull() & ~F.col("_ba"))), "pairs-held")
    cells = further.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor(F.col("high") / BIN))))
    asked = held.filter("_open").drop("_open")

    def below(df: DataFrame, other: str, place: str, out: str) -> DataFrame:
        places = asked.filter(F.col(place).isNotNull()).select("a", "b", F.col(place).alias("_place"), F.floor(F.col(place) / BIN).alias("_bin")).distinct()
        found = places.join(cells.withColumnRenamed("code", other), [other, "_bin"]).filter("_place BETWEEN low AND high")
        found = found.select("a", "b", F.lit(True).alias("_found")).distinct()
        return df.join(found, ["a", "b"], "left").withColumn(out, F.col(out) | F.coalesce("_found", F.lit(False))).drop("_found")

    answered = below(below(asked, "a", "_b_in_a", "_ab"), "b", "_a_in_b", "_ba")
    out = held.filter("NOT _open").drop("_open").unionByName(answered)
    outcome = F.when(F.col("a") == F.col("b"), "equivalent").when(F.col("_ab"), "subsumes").when(F.col("_ba"), "subsumed-by").otherwise("not-subsumed")
    return out.withColumn("outcome", outcome).select(*pairs.columns, "outcome")


# Closures that follow their edges, and closure tables.


def maintain_closure(closure: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The closure and the edges after edges have been added and removed, from those before.

    Only codes at or below the child of a changed edge can have other ancestors than before. Their
    pairs are derived again: the ways inside of them by path doubling, and where a way leaves them, the
    closure that is there already goes on. All other pairs stay as they are.
    """
    none = edges.select("child", "parent").limit(0)
    added, removed = (none if x is None else x.select("child", "parent").distinct() for x in (added, removed))
    after = cut(edges.select("child", "parent").distinct().join(removed, ["child", "parent"], "left_anti").unionByName(added).distinct(), "edges-after")
    touched = added.unionByName(removed).select(F.col("child").alias("code")).distinct()
    stale = cut(descendants(touched, closure, or_self=True), "stale")
    own = after.join(stale.select(F.col("code").alias("child")), "child", "left_semi").filter("child != parent AND child IS NOT NULL AND parent IS NOT NULL")
    inner = own.join(stale.select(F.col("code").alias("parent")), "parent", "left_semi")
    leaving = own.join(stale.select(F.col("code").alias("parent")), "parent", "left_anti")
    inside = cut(transitive_closure(inner.select("child", "parent")), "inside")
    # ways that leave: to the first code outside, and on with its closure
    starts = inside.select("descendant", F.col("ancestor").alias("child"), F.col("min_depth").alias("_up")).unionByName(stale.select(F.col("code").alias("descendant"), F.col("code").alias("child"), F.lit(0).alias("_up")))
    out = starts.join(leaving, "child").groupBy("descendant", F.col("parent").alias("_exit")).agg(F.min("_up").alias("_up"))
    above = closure.select(F.col("descendant").alias("_exit"), "ancestor", "min_depth")
    on = out.join(above, "_exit").select("descendant", "ancestor", (F.col("_up") + 1 + F.col("min_depth")).alias("min_depth"))
    made = inside.unionByName(out.select("descendant", F.col("_exit").alias("ancestor"), (F.col("_up") + 1).alias("min_depth"))).unionByName(on)
    again = made.filter("descendant != ancestor").groupBy("descendant", "ancestor").agg(F.min("min_depth").cast("int").alias("min_depth"))
    kept = closure.join(stale.select(F.col("code").alias("descendant")), "descendant", "left_anti").select("descendant", "ancestor", "min_depth")
    return cut(kept.unionByName(again), "closure-after"), after


def closure_delta(held: DataFrame, new: DataFrame, closure: DataFrame, concepts: DataFrame | None = None, systems: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, relation) that new codes add to a closure table that holds codes already.

    New codes that are held add nothing. Each is paired with every held code and every other new
    code that the closure relates it to; the source is the one below. Where held and closure name a system, so
    do the edges, and codes of two systems are never related. The closure has a row a pair, and each pair meets the codes once. With concepts and systems, codes of
    case-blind systems count as their system writes them, and two that are written differently are `equal`.
    """
    keys = ["system", "code"] if "system" in held.columns and "system" in closure.columns else ["code"]
    place = keys[:-1]
    fresh = new.select(*keys).distinct().join(held.select(*keys), keys, "left_anti").withColumn("_fresh", F.lit(True))
    everyone = held.select(*keys).distinct().withColumn("_fresh", F.lit(False)).unionByName(fresh)
    if concepts is not None and systems is not None:
        from termloom.operators.codes import with_own

        everyone = with_own(everyone, concepts, systems).select(*keys, "_fresh", F.coalesce("_own.code", "code").alias("_own"))
    else:
        everyone = everyone.withColumn("_own", F.col("code"))
    everyone = cut(everyone, "closure-codes")

    pairs, asked = closure.select(*place, "descendant", "ancestor"), everyone.filter("_fresh").select(*place, "_own").distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # of a few new codes only the pairs that have one move
        touch = lambda side, mark: F.broadcast(asked.select(*place, F.col("_own").alias(side), F.lit(True).alias(mark)))
        pairs = pairs.join(touch("descendant", "_down"), [*place, "descendant"], "left").join(touch("ancestor", "_up"), [*place, "ancestor"], "left").filter("_down OR _up").drop("_down", "_up")
    end = lambda side, name, mark: everyone.select(*place, F.col("_own").alias(side), F.col("code").alias(name), F.col("_fresh").alias(mark))
    met = pairs.join(end("descendant", "source", "_a"), [*place, "descendant"]).join(end("ancestor", "target", "_b"), [*place, "ancestor"]).filter("_a OR _b")
    both = met.select(*place, "source", "target", F.lit("specializes").alias("relation"))
    if concepts is None or systems is None:
        return both
    several = everyone.groupBy(*place, "_own").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")  # few codes are held in two spellings
    same = everyone.join(several, [*place, "_own"])
    left = same.select(*place, "_own", F.col("code").alias("source"), F.col("_fresh").alias("_a"))
    right = same.select(*place, "_own", F.col("code").alias("target"), F.col("_fresh").alias("_b"))
    equal = left.join(right, [*place, "_own"]).filter("_a AND source != target AND (NOT _b OR source < target)")
    return both.unionByName(equal.select(*place, "source", "target", F.lit("equal").alias("relation")))


class ClosureTable:
    """A named closure table: members and edges by version. Frames are immutable; each call returns a new table."""

    def __init__(self, members: DataFrame, edges: DataFrame, version: int, content: str) -> None:
        self.members, self.edges, self.version, self.content = members, edges, version, content

    @classmethod
    def init(cls, closure: DataFrame, content: str) -> ClosureTable:
        """An empty table; with systems, where the closure names them."""
        spark = closure.sparkSession
        kind = closure.schema["descendant"].dataType.simpleString()
        system = "system string, " if "system" in closure.columns else ""
        return cls(
            spark.createDataFrame([], f"{system}code {kind}, version int"),
            spark.createDataFrame([], f"{system}source {kind}, target {kind}, relation string, version int"), 0, content,
        )

    def extend(self, new: DataFrame, closure: DataFrame, content: str, concepts: DataFrame | None = None, systems: DataFrame | None = None) -> ClosureTable:
        """The next version; the same one where every code is held already. Content that has changed since init is refused."""
        if content != self.content:
            raise ValueError("the content has changed since this closure table was begun")
        keys = [c for c in self.members.columns if c != "version"]
        fresh = cut(new.select(*keys).distinct().join(self.members.select(*keys), keys, "left_anti"), "closure-members")
        if fresh.isEmpty():
            return self
        version = self.version + 1
        added = cut(closure_delta(self.members, fresh, closure, concepts, systems).withColumn("version", F.lit(version)), "closure-edges")
        members = self.members.unionByName(fresh.withColumn("version", F.lit(version)))
        return ClosureTable(members, self.edges.unionByName(added), version, self.content)

    def since(self, version: int) -> DataFrame:
        """Edges added after a version."""
        return self.edges.filter(F.col("version") > version)
