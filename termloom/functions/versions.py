"""Version order and version patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(version: Column) -> Column:
    return F.split(version, r"\.")


def version_key(version: Column) -> Column:
    """Sorts segment by segment: numbers by value, anything else by text; numbers before text."""
    key = lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(s, "^0+(?=.)", ""), 20, "0"))).otherwise(F.concat(F.lit("1"), s))
    return F.transform(segments(version), key)


def _plain(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]+$"), F.regexp_replace(s, "^0+(?=.)", "")).otherwise(s)


def version_matches(version: Column, pattern: Column) -> Column:
    """Segments are equal, numbers by value; `x` in the pattern stands for any segment, and for none at the end."""
    v, p = segments(version), segments(pattern)
    both = F.arrays_zip(p.alias("p"), v.alias("v"))
    one = lambda z: F.coalesce((F.lower(z["p"]) == "x") | (_plain(z["p"]) == _plain(z["v"])), F.lit(False))
    return (F.size(v) <= F.size(p)) & F.forall(both, one)
