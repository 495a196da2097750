"""URL filters: listed rules first, then logistic regression on hashed character n-grams (native).

The classifier is trained from a small labelled URL table by full-batch accelerated gradient
descent: each step is one DataFrame aggregation over the labelled rows, whose result has one row a
hash bucket (DIM + 1 numbers, whatever the input). Scoring is one expression over the arrays of
bucket numbers, with the weights as a constant, so that it needs no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, cut, free_names

DIM = 2_048
#: Up to so many rules are held as a constant; more are joined.
CONSTANT_RULES = 1_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as defined for op1: both empty where url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds `rule` (host and path as one string; null where none fits) and `rule_verdict`.

    rules: (verdict, host, path) as a list, or a DataFrame of these columns. A rule fits its host
    and all its subdomains where the path starts with the rule's path; the longest rule wins, a tie
    goes to the smaller string. A long rule list is joined on every suffix of the host.
    """
    if isinstance(rules, DataFrame):
        if rules.count() > CONSTANT_RULES:
            return _join_rules(urls, rules)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    known = json.dumps([{"size": -len(h + p), "rule": h + p, "verdict": v, "host": h, "path": p} for v, h, p in rules])
    table = F.from_json(F.lit(known), "array<struct<size:int,rule:string,verdict:string,host:string,path:string>>")
    fits = lambda r: ((F.col("host") == r.host) | F.endswith(F.col("host"), F.concat(F.lit("."), r.host))) & F.startswith(F.col("path"), r.path)
    best = F.array_min(F.filter(table, fits))
    (held,) = free_names(urls, "_best")
    return urls.withColumn(held, best).withColumn("rule", F.col(held)["rule"]).withColumn("rule_verdict", F.col(held)["verdict"]).drop(held)


def _join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every distinct (host, path) meets the rules of its host's suffixes; the best goes back to all its rows."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rules.select(F.col("verdict").alias("_v"), F.col("host").alias("_h"), F.col("path").alias("_p"))
    keys = urls.select("host", "path").distinct().withColumn("_h", F.explode(suffixes))
    met = keys.join(listed, "_h").filter(F.startswith(F.col("path"), F.col("_p")))
    met = met.withColumn("_rule", F.concat("_h", "_p"))
    (held,) = free_names(urls, "_best")
    best = met.groupBy("host", "path").agg(F.min(F.struct(-F.length("_rule"), "_rule", "_v")).alias(held))
    out = urls.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col(held)["_rule"]).withColumn("rule_verdict", F.col(held)["_v"]).drop(held)


def _grams(text: Column, mark: str, n: int) -> Column:
    chars = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)(.)"), F.lit(1))
    gram = lambda c, i: F.concat(F.lit(mark), c, *[F.get(chars, i + k) for k in range(1, n)])
    return F.filter(F.transform(chars, gram), lambda g: g.isNotNull())


def buckets(host: Column, path: Column) -> Column:
    """Distinct bucket numbers (1..DIM) of the character 3- and 4-grams of host and path."""
    grams = F.concat(*[_grams(c, m, n) for c, m in ((host, "h"), (path, "p")) for n in (3, 4)])
    return F.array_distinct(F.transform(grams, lambda g: (F.pmod(F.xxhash64(g), F.lit(DIM)) + 1).cast("int")))


def _logit(weights: list[float], grams: str = "_grams") -> Column:
    """weights[0] is the intercept. Features are scaled to length one."""
    w = F.from_json(F.lit(json.dumps(weights[1:])), "array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(w, b - 1))
    return F.lit(weights[0]) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def train(labelled: DataFrame, max_rows: int = 2_000, steps: int = 30, rate: float = 2.0, ridge: float = 1e-4) -> list[float]:
    """DIM + 1 weights from a small labelled table (host, path, label 0/1).

    max_rows bounds the sample that is fitted: the distinct (host, path) of least hash. Without any
    labelled row all weights are 0. Rows with a null label are left out; a (host, path) with both
    labels counts as its mean.
    """
    rows = labelled.filter("label IS NOT NULL").groupBy("host", "path").agg(F.avg("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows)
    rows = cut(rows.select("label", buckets(F.col("host"), F.col("path")).alias("_grams")), "url-sample")
    n = rows.count()
    weights = [0.0] * (DIM + 1)
    ahead, before = weights, weights
    for step in range(steps if n else 0):
        error = F.lit(1.0) / (1.0 + F.exp(-_logit(ahead))) - F.col("label")
        scale = F.sqrt(F.greatest(F.size("_grams"), F.lit(1)))
        terms = F.concat(F.array(F.struct(F.lit(0).alias("i"), error.alias("g"))), F.transform("_grams", lambda b: F.struct(b.alias("i"), (F.col("_e") / F.col("_s")).alias("g"))))
        sums = rows.withColumn("_e", error).withColumn("_s", scale).select(F.inline(terms)).groupBy("i").agg(F.sum("g").alias("g"))
        slope = [ridge * w for w in ahead]
        for i, g in sums.collect():  # DIM + 1 rows at most
            slope[i] += g / n
        weights = [a - rate * g for a, g in zip(ahead, slope)]
        pull = step / (step + 3)
        ahead = [round(w + pull * (w - b), 9) for w, b in zip(weights, before)]
        before = weights
    return [round(w, 6) for w in weights]


def score_urls(urls: DataFrame, weights: list[float]) -> DataFrame:
    """Adds `p_block`, the classifier's probability that a url with these host and path is to be blocked."""
    (grams,) = free_names(urls, "_grams")
    scored = urls.withColumn(grams, buckets(F.col("host"), F.col("path")))
    return scored.withColumn("p_block", 1.0 / (1.0 + F.exp(-_logit(weights, grams)))).drop(grams)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, labelled: DataFrame | None = None, max_rows: int = 2_000) -> DataFrame:
    """pages (with url) and host, path, rule, verdict, p_block; columns of these names are replaced, and one named rule_verdict goes.

    The verdict is the rule's where one fits and otherwise the classifier's (block above 0.5). With
    no labelled table the urls that a rule fits, with the rule's verdict, serve as one, up to
    max_rows of them. A null url, or one without `://`, has an empty host and path and gets the
    classifier's verdict on those. Repeated rows get equal results, other columns are passed on, and
    an empty table gives an empty result.
    """
    pages = pages.drop("host", "path", "rule", "rule_verdict", "verdict", "p_block")
    host, path = url_parts(F.col("url"))
    ruled = match_rules(pages.withColumn("host", host).withColumn("path", path), rules)
    if labelled is None:
        labelled = ruled.filter("rule IS NOT NULL").select("host", "path", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    scored = score_urls(ruled, train(labelled, max_rows))
    learned = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", learned)).drop("rule_verdict")
