"""Checksum tests of identifiers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlake.functions.patterns import BLANK, BLANKS


def _digits(number: Column) -> Column:
    return F.transform(F.split(number, ""), lambda c: c.try_cast("int"))


def national_id_ok(number: Column) -> Column:
    """Ten digits, not all the same, the last one the weighted sum's remainder of 11 (or 11 less it)."""
    digits = _digits(number)
    weighted = F.zip_with(F.slice(digits, 1, 9), F.array(*(F.lit(w) for w in range(10, 1, -1))), lambda d, w: d * w)
    rest = F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11
    shape = number.rlike(r"\A[0-9]{10}\z") & ~number.rlike(r"\A(.)\1{9}\z")
    return F.coalesce(shape & (F.get(digits, F.lit(9)) == F.when(rest < 2, rest).otherwise(11 - rest)), F.lit(False))


def card_ok(number: Column) -> Column:
    """Sixteen digits that pass Luhn's test."""
    return F.coalesce(number.rlike(r"\A[0-9]{16}\z") & F.when(number.rlike(r"\A[0-9]+\z"), F.call_function("luhn_check", number)), F.lit(False))


def iban_ok(raw: Column) -> Column:
    """The remainder of 97 is 1; Iranian numbers are 26 characters long."""
    iban = F.upper(F.regexp_replace(raw, f"{BLANK}|-", ""))
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest, c):
        digit = c.try_cast("int")
        return F.when(digit.isNotNull(), rest * 10 + digit).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    shape = iban.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (~iban.startswith("IR") | (F.length(iban) == 26))
    return F.coalesce(shape & (F.when(shape, rest) == 1), F.lit(False))


def flat(candidate: Column) -> Column:
    """A grouped number without its blanks and hyphens."""
    return F.regexp_replace(candidate, f"[{BLANKS}-]", "")
