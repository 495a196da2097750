"""Search over designations: a word index, prefix search of many queries at once, ranks and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import primary_language, tokens
from termloom.tables import cut, small

#: Query words whose ranges an index file is read by.
FEW = 32
#: Letters of the longest starts whose first hits short_pages keeps, and how many it keeps of each.
SHORT, KEPT = 3, 1_000


def inverted_index(designations: DataFrame, key: str = "designation_id") -> DataFrame:
    """(word, key): one row a distinct word of a term."""
    return designations.select(key, F.explode(tokens(F.col("term"))).alias("word"))


def write_index(index: DataFrame, path: str) -> None:
    """Sorted by word inside range partitions, so that a prefix reads few row groups."""
    index.repartitionByRange("word").sortWithinPartitions("word").write.parquet(path)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, _words) of queries (query_id, text) that have a word."""
    return queries.select("query_id", F.sort_array(tokens(F.col("text"))).alias("_words")).filter(F.size("_words") > 0)


def prefix_search(queries: DataFrame, index: DataFrame, key: str = "designation_id") -> DataFrame:
    """(query_id, key): terms in which every word of the query (query_id, text) starts some word.

    Queries of the same words are asked once. Queries without a word match nothing.
    """
    asked = _asked(queries)
    return asked.join(_found(asked, index, key), "_words").select("query_id", key)


def _found(asked: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(_words, key): the hits of each distinct list of query words.

    Each word of the vocabulary, cut to the lengths that query words have, meets the query words as a whole, and only
    the words found meet the index. Of each key the query words that it has move once; a list of words then meets the keys
    that have its rarest one, and is tested on these. Where query words are few, the index is read by their ranges, so that of a
    sorted file few row groups are touched.
    """
    texts = asked.select("_words").distinct().withColumn("start", F.explode("_words"))
    starts = texts.select("start").distinct()
    lengths, few = starts.agg(F.sort_array(F.collect_set(F.length("start"))), F.slice(F.sort_array(F.collect_set(F.when(F.length("start") <= 64, F.col("start")))), 1, FEW + 1)).first()
    if not lengths:
        return asked.select("_words").join(index.limit(0).select(key), F.lit(False))
    if len(few) <= FEW and lengths[-1] <= 64:
        index = index.filter(reduce(lambda a, b: a | b, [F.col("word").between(w, w + chr(0x10FFFF)) for w in few]))
    cuts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("word")), lambda n: F.substring("word", F.lit(1), n))
    words = index.filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(words.withColumn("start", F.explode(cuts)).join(starts, "start", "left_semi"), "words-met")
    often = texts.join(pairs.groupBy("start").agg(F.sum("n").alias("n")), "start")
    driven = often.groupBy("_words").agg(F.min_by("start", F.struct("n", "start")).alias("_start"), F.count(F.lit(1)).alias("_met")).filter(F.col("_met") == F.size("_words"))
    held = index.join(pairs.select("word", "start"), "word").groupBy(key).agg(F.collect_set("start").alias("_have"))
    met = held.withColumn("_start", F.explode("_have")).join(small(cut(driven.select("_words", "_start"), "words-asked")), "_start")
    return met.filter(F.size(F.array_except("_words", "_have")) == 0).select("_words", key)


def search_filters(designations: DataFrame, language: str | None = None, refset: DataFrame | None = None, uses: list[str] | None = None, active_only: bool = True) -> DataFrame:
    """Designations that may be found; refset is (designation_id) of a language reference set."""
    out = designations.filter("active") if active_only else designations
    if language:
        out = out.filter(primary_language(F.col("language")) == primary_language(F.lit(language)))
    if refset is not None:
        out = out.join(refset.select("designation_id"), "designation_id", "left_semi")
    return out.filter(F.col("use_code").isin(uses)) if uses else out


def rank_page(hits: DataFrame, designations: DataFrame, offset: int, count: int) -> DataFrame:
    """Each query's hits, shortest term first, then by code: query_id, code, term, place, total."""
    named = hits.join(designations.select("designation_id", "code", "term"), "designation_id")
    order = Window.partitionBy("query_id").orderBy(F.length("term"), "code", "designation_id")
    first = named.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= offset + count)  # each task keeps a query's first ones
    placed = first.withColumn("place", F.col("_row") - 1).filter(F.col("place") >= offset)
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return placed.join(totals, "query_id").select("query_id", "code", "term", "place", "total")


def search_page(queries: DataFrame, index: DataFrame, designations: DataFrame, offset: int, count: int) -> DataFrame:
    """rank_page of prefix_search: query_id, code, term, place, total. Queries of the same words are ranked once, so that hits are not multiplied by them."""
    asked = _asked(queries)
    page = rank_page(_found(asked, index, "designation_id").withColumnRenamed("_words", "query_id"), designations, offset, count)
    return asked.join(page.withColumnRenamed("query_id", "_words"), "_words").select("query_id", "code", "term", "place", "total")


def ranked_index(designations: DataFrame) -> DataFrame:
    """(word, rank): an inverted index whose key is what hits are ranked by, so that hits need no terms to be put in order: length of the term, code, designation_id."""
    rank = F.struct(F.length("term").alias("length"), "code", "designation_id")
    return inverted_index(designations.withColumn("rank", rank), "rank")


def short_pages(index: DataFrame, longest: int = SHORT, keep: int = KEPT) -> DataFrame:
    """(start, place, rank, total): of each start of up to `longest` letters, the first `keep` hits in a ranked_index, and how many it has.

    Each rank moves once, with its starts. Hits are counted by start and length of term first, so that only those no longer than a
    start's first `keep` are put in order.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word"))), lambda n: F.substring("word", F.lit(1), n))
    held = index.filter("word != ''").groupBy("rank").agg(F.array_distinct(F.flatten(F.collect_list(cuts))).alias("_starts"))
    hits = cut(held, "starts").select("rank", F.explode("_starts").alias("start"))
    counts = cut(hits.groupBy("start", F.col("rank.length").alias("length")).agg(F.count(F.lit(1)).alias("n")), "start-lengths")
    upto = F.sum("n").over(Window.partitionBy("start").orderBy("length"))
    ends = counts.withColumn("_before", upto - F.col("n")).groupBy("start").agg(F.max(F.when(F.col("_before") < keep, F.col("length"))).alias("_last"), F.sum("n").alias("total"))
    near = hits.join(small(cut(ends, "start-ends")), "start").filter(F.col("rank.length") <= F.col("_last"))
    order = Window.partitionBy("start").orderBy("rank")
    first = near.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= keep)
    return first.select("start", (F.col("_row") - 1).alias("place"), "rank", "total")


def first_page(
    queries: DataFrame, index: DataFrame, designations: DataFrame, offset: int, count: int, short: DataFrame | None = None, longest: int = SHORT, keep: int = KEPT
) -> DataFrame:
    """prefix_search and rank_page in one: query_id, code, term, place, total.

    index is a ranked_index of designations. Queries of the same words are asked once. Each task passes on no more than their first
    offset + count hits, and only the page's own meet designations, for their terms; the rest are counted. With `short` (short_pages of
    the index, with the same `longest` and `keep`) the many hits of one short word alone are never built: it reads its page.
    Pages that end beyond `keep` take the general way.
    """
    asked = _asked(queries)
    alone = (F.size("_words") == 1) & (F.length(F.col("_words")[0]) <= longest) if short is not None and offset + count <= keep else F.lit(False)
    hits = _found(asked.filter(~alone), index, "rank")
    order = Window.partitionBy("_words").orderBy("rank")
    first = hits.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= offset + count)  # cut off before and after the shuffle
    page = first.filter(F.col("_row") > offset).select("_words", (F.col("_row") - 1).alias("place"), "rank")
    page = page.join(hits.groupBy("_words").agg(F.count(F.lit(1)).alias("total")), "_words")
    if short is not None:
        starts = asked.filter(alone).select("_words", F.col("_words")[0].alias("start")).distinct()
        read = starts.join(short.filter((F.col("place") >= offset) & (F.col("place") < offset + count)), "start")
        page = page.unionByName(read.select("_words", "place", "rank", "total"))
    page = page.select("_words", "place", "rank.designation_id", "rank.code", "total").join(designations.select("designation_id", "term"), "designation_id")
    return asked.join(page, "_words").select("query_id", "code", "term", "place", "total")


def match_all_terms(queries: DataFrame, designations: DataFrame) -> DataFrame:
    """(query_id, code): concepts where every query word starts a word of some active term, not always the same one."""
    return prefix_search(queries, inverted_index(designations.filter("active"), "code").distinct(), "code")
