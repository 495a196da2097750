"""Check digits and the shape of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplication and permutation tables of the Verhoeff scheme (dihedral group of ten).
_TIMES = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
_PERMUTE = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
# Component kinds of the second partition digit.
COMPONENTS = {"0": "concept", "1": "description", "2": "relationship"}
# Partitions of short and of long (namespaced) identifiers; 16 holds expressions.
SHORT, LONG = ["00", "01", "02"], ["10", "11", "12", "16"]


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def verhoeff_state(digits: Column) -> Column:
    """0 where the digits, check digit last, are valid."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.get(_table(_PERMUTE), (i % 8) * 10 + d.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda state, x: F.get(_table(_TIMES), state * 10 + x))


def concept_id_reason(c: Column) -> Column:
    """Null for a well-formed identifier of 6 to 18 digits, else why it is not one."""
    partition = F.substring(c, -3, 2)
    return (
        F.when(c.isNull() | ~c.rlike("^[0-9]+$"), "not-digits")
        .when(F.startswith(c, F.lit("0")), "leading-zero")
        .when(~F.length(c).between(6, 18), "length")
        .when(~partition.isin(*SHORT, *LONG), "partition")
        .when(partition.isin(*LONG) & (F.length(c) < 11), "namespace")
        .when(verhoeff_state(c) != 0, "check-digit")
    )


def component_kind(c: Column) -> Column:
    digit = F.substring(c, -2, 1)
    out = F.when(F.substring(c, -3, 2) == "16", "expression")
    for key, kind in COMPONENTS.items():
        out = F.when(digit == key, kind).otherwise(out)
    return out


def namespace(c: Column) -> Column:
    """The seven digits before the partition of a long-format identifier; null for the short format."""
    return F.when(F.substring(c, -3, 1) == "1", F.substring(c, -10, 7))


def mod10_digit(digits: Column) -> Column:
    """The check digit (as an int) of a number whose digits are doubled from the right, every second one."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")),
    )
    return (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10


def checked_number_reason(c: Column) -> Column:
    """Null for digits, a hyphen and their mod-10 check digit (perhaps after a prefix of letters), else why it is not one."""
    return (
        F.when(c.isNull() | ~c.rlike("^[A-Z]*[0-9]+-[0-9]$"), "shape")
        .when(mod10_digit(F.regexp_extract(c, "([0-9]+)-", 1)) != F.substring(c, -1, 1).cast("int"), "check-digit")
    )
