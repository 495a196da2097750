"""Text folding, tokens and matching as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _fold_table() -> tuple[str, str, str]:
    """Characters that are one other character once they are decomposed and their marks dropped, those characters, and all marks; of every script."""
    pairs, marks = [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x2FA20)]:
        c = chr(code)
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
        elif unicodedata.decomposition(c):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
            if len(base) == 1 and base != c:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "".join(marks)


_FROM, _TO, _MARKS = _fold_table()


def fold(c: Column) -> Column:
    """Lower case without marks, in every script; ß stays ß, and Hangul syllables stay whole. Marks are dropped (characters beyond the replacement's end)."""
    return F.lower(F.translate(c, _FROM + _MARKS, _TO))


def words(c: Column) -> Column:
    """Folded words in order, with repeats; null gives null."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Distinct folded words, sorted."""
    return F.sort_array(F.array_distinct(words(c)))


def starts_words(term: Column, query: Column) -> Column:
    """Every word of query is the start of some word of term, in any order."""
    have = words(term)
    return F.forall(words(query), lambda w: F.exists(have, lambda t: F.startswith(t, w)))


def wildcard_regex(pattern: str) -> str:
    """`*` stands for any run of characters; `\\*` and `\\\\` for themselves; everything else is literal."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and pattern[i + 1 : i + 2] in ("*", "\\"):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if pattern[i] == "*" else re.escape(pattern[i]))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def matches_wildcard(term: Column, pattern: str) -> Column:
    return term.rlike(wildcard_regex(pattern))


def primary_language(tag: Column) -> Column:
    return F.lower(F.get(F.split(tag, "[-_]"), F.lit(0)))


def same_language(a: Column, b: Column) -> Column:
    return primary_language(a) == primary_language(b)
