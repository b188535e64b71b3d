"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unlike or zero vectors."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def usable(v: Column, dim: int) -> Column:
    """Present, of this length, finite and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hashed_words(text: Column, dim: int) -> Column:
    """Words counted at a 32-bit rolling hash's place, scaled to length one."""
    from promptlake.functions.patterns import BLANK

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{BLANK}+"), lambda w: w != "")
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    def place(word):
        step = lambda h, c: wrap(h * 31 + F.ascii(c).cast("bigint"))
        return F.abs(F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)) % dim

    count = lambda places: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    scaled = lambda counts: _let(F.sqrt(dot(counts, counts)), lambda size: F.when(size > 0, F.transform(counts, lambda x: x / size)).otherwise(counts))
    return _let(F.transform(words, place), lambda places: _let(count(places), scaled))
