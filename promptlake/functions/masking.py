"""Masking of phone numbers, private addresses, national IDs and dictionary terms.

``guard="strict"`` does not start or end a number inside a longer one;
``guard="compat"`` keeps the guards of the first implementation, which let that happen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlake.functions.checksums import national_id_ok
from promptlake.functions.detectors import DICTIONARY_KINDS, alternation
from promptlake.functions.patterns import AFTER, ANY_DIGIT, ARABIC_DIGITS, BEFORE, BLANKS, PERSIAN_DIGITS, found, text_of
from promptlake.functions.text import ascii_digits

# Area codes of provinces.
AREA_CODES = "21 26 31 34 35 38 41 44 51 54 56 58 61 66 71 74 76 77 81 83 84 86 87".split()
LABELS = ["MASKED_MOBILE", "MASKED_LANDLINE", "INTERNAL_IP", "NATIONAL_ID", *DICTIONARY_KINDS]


def _digits(number: str, compat: bool) -> str:
    """Each digit in its three scripts (compat: without the Arabic one)."""
    forms = [(d, PERSIAN_DIGITS[int(d)], PERSIAN_DIGITS[1] if compat and d == "1" else ARABIC_DIGITS[int(d)]) for d in number]
    return "".join(f"[{''.join(f)}]" for f in forms)


def _guards(guard: str, extra: str = "") -> tuple[str, str]:
    if guard == "strict":
        return f"(?<![{ANY_DIGIT}{extra}])", f"(?![{ANY_DIGIT}{extra.replace('+', '')}])"
    if guard == "compat":
        follow = "." if "." in extra else ""
        return rf"(?<![\[{ANY_DIGIT}]{follow}\])", rf"(?![\[{ANY_DIGIT}]{follow}\])"
    raise ValueError("guard must be strict or compat")


def patterns(guard: str = "strict") -> dict[str, str]:
    compat = guard == "compat"
    d = lambda n: _digits(n, compat)
    before, after = _guards(guard)
    before_mobile, _ = _guards(guard, "+")
    before_dot, after_dot = _guards(guard, ".")
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "MASKED_MOBILE": rf"{before_mobile}(?:\+{d('98')}|{d('0098')}|{d('98')}|{d('0')}){d('9')}[{ANY_DIGIT}]{{9}}{after}",
        "MASKED_LANDLINE": rf"{before}{d('0')}(?:{'|'.join(map(d, AREA_CODES))})[\-{BLANKS}]?[{ANY_DIGIT}]{{8}}{after}",
        "INTERNAL_IP": rf"{before_dot}(?:10\.{octet}\.{octet}\.{octet}|172\.(?:1[6-9]|2[0-9]|3[01])\.{octet}\.{octet}|192\.168\.{octet}\.{octet}){after_dot}",
        "NATIONAL_ID": f"{before_dot}[{ANY_DIGIT}]{{10}}{after_dot}",
    }


def _replace_valid(text: Column, pattern: str, valid, put: str) -> tuple[Column, Column]:
    """The text with valid matches replaced, and their number."""
    pieces = F.split(text, pattern, -1)
    matches = F.transform(found(text, pattern), lambda m: F.when(valid(m), F.lit(put)).otherwise(m))
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, matches, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))))
    return joined, F.size(F.filter(found(text, pattern), valid))


def _where(text: Column, needs: str, replaced: Column, n: Column) -> tuple[Column, Column]:
    """A step's results; texts without what its matches need (a cheaper pattern) stay as they are."""
    some = text.rlike(needs)
    return F.when(some, replaced).otherwise(text), F.when(some, n).otherwise(0)


def steps(text: Column, terms: dict[str, list[str]] | None = None, guard: str = "strict"):
    """Yield (label, text after the step, number of masks of the step), in the fixed order."""
    told = patterns(guard)
    digits = f"[{ANY_DIGIT}]{{8}}"
    for label, needs in (("MASKED_MOBILE", digits), ("MASKED_LANDLINE", digits), ("INTERNAL_IP", r"[0-9]\.[0-9]")):
        yield label, lambda t, p=told[label], put=f"[{label}]", needs=needs: _where(t, needs, F.regexp_replace(t, p, put), F.regexp_count(t, F.lit(p)))
    yield "NATIONAL_ID", lambda t: _where(t, digits, *_replace_valid(t, told["NATIONAL_ID"], lambda m: national_id_ok(ascii_digits(m)), "[NATIONAL_ID]"))
    for kind in DICTIONARY_KINDS:
        pattern = alternation((terms or {}).get(kind, []))
        if pattern:
            yield kind, lambda t, p=pattern, put=f"[{kind}]": _where(t, p, F.regexp_replace(t, p, put), F.regexp_count(t, F.lit(p)))


def mask(df, text: str = "text", terms: dict[str, list[str]] | None = None, guard: str = "strict", masked: str = "masked_text", findings: str = "findings"):
    """df with the masked text and array<struct<label, count>>, most first (ties in the steps' order)."""
    out = df.withColumn(masked, text_of(F.col(text)))
    labels = []
    for i, (label, step) in enumerate(steps(F.col(masked), terms, guard)):
        replaced, n = step(F.col(masked))
        out = out.withColumn(f"n{i}__", n).withColumn(masked, replaced)
        labels.append((i, label))
    every = F.array(*(F.struct((-F.col(f"n{i}__")).alias("order"), F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}__").alias("count")) for i, label in labels))
    kept = F.array_sort(F.filter(every, lambda x: x["count"] > 0))
    return out.withColumn(findings, F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["count"].alias("count")))).drop(*(f"n{i}__" for i, _ in labels))


def total(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0), lambda a, x: a + x["count"])


def described(findings: Column) -> Column:
    """Labels with their counts, for people."""
    return F.array_join(F.transform(findings, lambda x: F.concat(x["label"], F.lit(" ×"), x["count"].cast("string"))), "، ")


def unresolved(masked: Column, required: Column) -> Column:
    """What a complete mask may not leave: required entities, and valid national IDs in any digits."""
    left = F.filter(required, lambda r: F.contains(masked, r))
    ids = F.filter(found(ascii_digits(masked), f"{BEFORE}[0-9]{{10}}{AFTER}"), national_id_ok)
    return F.concat(F.transform(left, lambda r: F.concat(F.lit("UNRESOLVED_REQ_"), r)), F.transform(ids, lambda m: F.concat(F.lit("UNMASKED_NATIONAL_ID:"), m)))


def preview(text: Column, size: int = 120) -> Column:
    """Digits starred, cut with an ellipsis."""
    starred = F.regexp_replace(text_of(text), f"[{ANY_DIGIT}]", "*")
    return F.when(F.length(starred) > size, F.concat(F.substring(starred, 1, size), F.lit("…"))).otherwise(starred)


__all__ = ["LABELS", "described", "mask", "patterns", "preview", "steps", "total", "unresolved"]
