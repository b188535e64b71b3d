"""Regular-expression parts that keep their meaning in Java.

Only this module writes blanks, digits and word borders: Java's own classes are
Unicode-aware in other ways than the semantics wanted here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a class: every character that counts as white space, the no-break ones and U+FEFF included.
BLANKS = r"\t\n\x0B\f\r    -     　﻿"
BLANK = f"[{BLANKS}]"
SOLID = f"[^{BLANKS}]"
#: ASCII word borders.
BEFORE = r"(?<![0-9A-Za-z_])"
AFTER = r"(?![0-9A-Za-z_])"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ANY_DIGIT = "0-9۰-۹٠-٩"
ZWNJ = "‌"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of every match; offsets count code points from zero.

    The pieces between matches give the offsets, so no Python is needed. Patterns
    must not match the empty string.
    """
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.length(pieces[0]).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, text: string>>)").alias("out"))

    def step(state, x):
        end = state["at"] + F.length(x["match"])
        hit = F.struct(state["at"].alias("start"), end.alias("end"), x["match"].alias("text"))
        return F.struct((end + F.length(x["gap"])).alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

    matches = found(text, pattern)
    pairs = F.zip_with(matches, F.slice(pieces, 2, 1 << 30), lambda m, g: F.struct(m.alias("match"), F.coalesce(g, F.lit("")).alias("gap")))
    # most texts hold no match: one search decides, the rest runs for the others
    return F.when(~F.coalesce(text.rlike(pattern), F.lit(False)), start["out"]).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def quote(term: str) -> str:
    """A term as a pattern that matches just it."""
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\-&~#" else c for c in term)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of a few literal words occurs."""
    told = F.lit(False)
    for w in words:
        told = told | F.contains(text, F.lit(w))
    return told
