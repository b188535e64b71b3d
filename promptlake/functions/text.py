"""Normalisation, tokens and sentences."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from promptlake.functions.patterns import ARABIC_DIGITS, BLANK, BLANKS, PERSIAN_DIGITS, ZWNJ, text_of

#: Characters that a joiner may stand between.
_LETTER = r"[A-Za-zء-يٱ-ۓەۥۦ]"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts of ASCII never leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)


def persian_letters(text: Column) -> Column:
    """Arabic yeh and kaf as their Persian forms."""
    return F.translate(text, "يك", "یک")


#: The characters of BLANKS.
BLANK_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", " ")


_FOLDED = {ord(d): str(i) for script in (PERSIAN_DIGITS, ARABIC_DIGITS) for i, d in enumerate(script)} | {ord("ي"): "ی", ord("ك"): "ک"}
_TO_FOLD = re.compile(f"[{''.join(map(chr, _FOLDED))}]")
_STRAY = re.compile(f"(?<!{_LETTER}){ZWNJ}|{ZWNJ}(?!{_LETTER})")
_BLANK_RUN = re.compile(f"{BLANK}+")
#: What str.split() cuts at and BLANKS lacks, and what BLANKS has beside.
_SPLIT_DIFFERS = "\x1c\x1d\x1e\x1f\x85\ufeff"


def _squeezed(text: str) -> str:
    """Each run of blanks as one space, none at the ends."""
    if any(c in text for c in _SPLIT_DIFFERS):
        return _BLANK_RUN.sub(" ", text).strip(BLANK_CHARACTERS)
    return " ".join(text.split())


def normalized_literal(text: str) -> str:
    """What `normalize` makes of a literal, without a job."""
    if not text.isascii():
        if _TO_FOLD.search(text):
            text = text.translate(_FOLDED)
        if ZWNJ in text:
            text = _STRAY.sub("", text)
    text = _squeezed(text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        # may turn a sign into a space and a mark
        text = unicodedata.normalize("NFKC", text).strip(BLANK_CHARACTERS)
    return text.lower()


@F.arrow_udf(StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return pa.array([normalized_literal(t or "") for t in texts.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """Letters and digits unified, stray joiners dropped, blanks squeezed, then NFKC, trimmed, small letters; null is empty.

    The order matters: presentation forms that NFKC opens up keep their Arabic letters.
    One Arrow function does it all, so the result is computed once however often a plan names it.
    """
    return _normalize(text)


def char_hygiene(text: Column) -> Column:
    """For repair: NFKC first, then letters, runs of tatweel to one."""
    return F.regexp_replace(persian_letters(nfkc(text_of(text))), "ـ{2,}", "ـ")


_TATWEELS = re.compile("ـ{2,}")


def hygienic_literal(text: str) -> str:
    """What `char_hygiene` makes of a literal, without a job."""
    if text.isascii():
        return text
    return _TATWEELS.sub("ـ", unicodedata.normalize("NFKC", text).replace("ي", "ی").replace("ك", "ک"))


def words_of(text: str) -> list[str]:
    """What lies between the blanks of a literal."""
    if any(c in text for c in _SPLIT_DIFFERS):
        return [w for w in _BLANK_RUN.split(text) if w]
    return text.split()


def tokens_ascii(text: Column) -> Column:
    """Small-letter runs of ASCII word characters and joiners."""
    return F.filter(F.split(F.lower(text_of(text)), f"[^0-9A-Za-z_{ZWNJ}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Retrieval tokens: cut at blanks and marks, longer than one character."""
    cut = rf"[{BLANKS},،؛.!؟?:\-_()\[\]{{}}\"]+"
    return F.filter(F.split(F.lower(text_of(text)), cut), lambda w: F.length(w) > 1)


#: What both keep of small letters, for Python's re.
RUNS = {tokens_ascii: re.compile(f"[0-9A-Za-z_{ZWNJ}]+"), tokens: re.compile(rf"[^{BLANKS},،؛.!؟?:\-_()\[\]{{}}\"]{{2,}}")}


def token_numbers(normal: Column) -> Column:
    """struct<n_ascii, n_tokens>: how many of `tokens_ascii` and of `tokens` a normal text has; no token becomes a value."""
    ddl, runs = "struct<n_ascii: bigint, n_tokens: bigint>", [RUNS[tokens_ascii], RUNS[tokens]]

    @F.arrow_udf(ddl)
    def count(texts: pa.Array) -> pa.Array:
        told = [t or "" for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(r.findall(t)) for t in told], pa.int64()) for r in runs], ["n_ascii", "n_tokens"])

    return count(normal)


def sentences(text: Column) -> Column:
    """Pieces after . ! ? ؟ ؛ or a line break; the trimmed text itself if there are none."""
    parts = F.filter(F.transform(F.split(text_of(text), rf"(?<=[.!؟؛?\n]){BLANK}+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text_of(text))))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
