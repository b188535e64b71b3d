"""Repair of Persian text whose ligatures were turned round when it was extracted.

Damaged words are looked up once per different word: the different words that may have
a repair are repaired, and the repairs joined back by hash, so that work grows with the
vocabulary. What remains is done text by text in one Arrow function. The lexicon (word, rank) is a table of any size that
the caller gives: whatever a word's repair may look up is joined to it.
"""

from __future__ import annotations

import re
from itertools import islice
from operator import eq

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from promptlake.functions.patterns import ZWNJ
from promptlake.functions.text import BLANK_CHARACTERS, hygienic_literal, words_of
from promptlake.session import ship_package

# Pairs that extraction turns round, and endings that a stem may carry.
PAIRS = ("ال", "لا", "رت", "تر", "نت", "تن", "رب", "بر")
ENDINGS = ("های", "ها", "ان", "ی")

PERSIAN = "[؀-ۿ]"
#: What may hold Persian: its signs, and forms of them that NFKC opens up.
MAY_BE_PERSIAN = r"[؀-ۿ\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}\x{1EE00}-\x{1EEFF}]"
_PERSIAN_SIGN = re.compile(PERSIAN)
_DIGIT = re.compile("[0-9۰-۹]")
_WORD = regex.compile(rf"[\p{{L}}\p{{N}}{ZWNJ}]+")
_LONE = frozenset((".", "،", "؛", ":", "!", "؟", "..", "..."))


def lexicon(words: DataFrame) -> DataFrame:
    """(word, rank): the first rank of every word, joiners left out."""
    return words.select(F.replace("word", F.lit(ZWNJ), F.lit("")).alias("word"), "rank").groupBy("word").agg(F.min("rank").alias("rank"))


def swaps(token: str) -> list[str]:
    """The token with one turned pair put back, for each place."""
    return [token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1) if token[i : i + 2] in PAIRS]


def repaired_word(token: str, ranks: dict[str, int]) -> str | None:
    """The likeliest known word one swap away, else two; else with a known ending set aside."""
    if not 3 <= len(token) <= 32 or token in ranks:
        return None
    once = swaps(token)
    twice = (w for mid in once if mid not in ranks for w in swaps(mid) if w != token)
    for candidates in (once, twice):
        known = [w for w in candidates if w in ranks]
        if known:
            return min(known, key=ranks.__getitem__)
    for ending in ENDINGS:
        stem = token[: -len(ending)]
        if token.endswith(ending) and len(stem) >= 3 and stem not in ranks:
            fixed = repaired_word(stem, ranks)
            if fixed:
                return fixed + ending
    return None


def lookups(token: str) -> set[str]:
    """Every word that the repair of a token may look up."""
    if not 3 <= len(token) <= 32:
        return set()
    once = swaps(token)
    found = {token, *once, *(w for mid in once for w in swaps(mid))}
    for ending in ENDINGS:
        if token.endswith(ending) and len(token) - len(ending) >= 3:
            found |= lookups(token[: -len(ending)])
    return found


def word_repairs(words: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """(word, repaired) of the different words that have a repair."""
    ship_package(words.sparkSession)

    @F.arrow_udf("array<string>")
    def asked(tokens: pa.Array) -> pa.Array:
        return pa.array([sorted(lookups(t.as_py())) for t in tokens], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def fix(tokens: pa.Array, known: pa.Array) -> pa.Array:
        ranks = [{x["candidate"]: x["rank"] for x in k.as_py()} for k in known]
        return pa.array([repaired_word(t.as_py(), r) for t, r in zip(tokens, ranks, strict=True)], pa.string())

    each = words.select("word").distinct().select("word", F.explode(asked("word")).alias("candidate"))
    known = each.join(lexicon_.select(F.col("word").alias("candidate"), "rank"), "candidate").groupBy("word").agg(F.collect_list(F.struct("candidate", "rank")).alias("known"))
    return known.select("word", fix("word", "known").alias("repaired")).where("repaired IS NOT NULL AND repaired <> word")


def damaged(text: str) -> set[str]:
    """The different Persian words of a text, joiners left out, that may have a repair: those that hold a turned pair."""
    if not _PERSIAN_SIGN.search(text):
        return set()
    bare = {w.replace(ZWNJ, "") for w in _WORD.findall(text)}
    return {w for w in bare if 3 <= len(w) <= 32 and any(p in w for p in PAIRS)}


def _swapped(text: str, repairs: dict[str, str]) -> tuple[str, int]:
    n = 0

    def put(m):
        nonlocal n
        word = repairs.get(m[0].replace(ZWNJ, ""))
        n += word is not None
        return m[0] if word is None else word

    return (_WORD.sub(put, text), n) if repairs else (text, 0)


def _is_persian(token: str) -> bool:
    n = len(_PERSIAN_SIGN.findall(token))
    return n > 0 and n >= (len(token) - token.count(ZWNJ)) / 2


def _is_noise(token: str) -> bool:
    return len(token) <= 2 and not _PERSIAN_SIGN.search(token) and not _DIGIT.search(token)


def tidy(line: str) -> tuple[str, int, int]:
    """(text, glued, junk): lone marks joined to the word before, stray Latin letters among Persian words dropped."""
    words, glued, junk = words_of(line), 0, 0
    # most lines hold no Persian word, many no lone mark
    persian = [_is_persian(w) for w in words] if _PERSIAN_SIGN.search(line) else []
    if persian or not _LONE.isdisjoint(words):
        out: list[str] = []
        for i, w in enumerate(words):
            if w in _LONE:
                if out:
                    out[-1] += w
                    glued += 1
            elif persian and _is_noise(w) and (any(persian[i + 1 : i + 2]) or (i > 0 and persian[i - 1])):
                junk += 1
            else:
                out.append(w)
        words = out
    text = " ".join(words)
    for mark in "،؛!؟":
        text = text.replace(" " + mark, mark)
    return text, glued, junk


def _repeat(words: list[str]) -> tuple[int, int] | None:
    """(place, number of words) of a phrase that follows itself: the longest, of these the first."""
    for n in range(8, 2, -1):
        # a phrase of n words follows itself where n words on end stand again n places on
        same, run = bytes(map(eq, words, islice(words, n, None))), b"\1" * n
        at = same.find(run)
        while at >= 0:
            if sum(map(len, words[at : at + n])) >= 12:
                return at, n
            at = same.find(run, at + 1)
    return None


def _collapse(line: str) -> tuple[str, int]:
    """A line without phrases of 3 to 8 words that follow themselves; up to three."""
    words, times = line.split(), 0
    while times < 3 and (found := _repeat(words)):
        at, n = found
        del words[at + n : at + 2 * n]
        times += 1
    return (" ".join(words), times) if times else (line, 0)


def repaired_text(text: str, repairs: dict[str, str]) -> tuple[str, int, int, int, int]:
    """(text, swapped, glued, junk, collapsed) of one text, line by line."""
    text, swapped = _swapped(hygienic_literal(text), repairs)
    lines, glued, junk, collapsed = [], 0, 0, 0
    for line in text.split("\n"):
        line, g, j = tidy(line)
        line, c = _collapse(line)
        lines.append(line)
        glued, junk, collapsed = glued + g, junk + j, collapsed + c
    return "\n".join(lines).strip(BLANK_CHARACTERS), swapped, glued, junk, collapsed


_COUNTS = ("swapped", "glued", "junk", "collapsed")


@F.arrow_udf(ArrayType(StringType()))
def _damaged(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(damaged(hygienic_literal(t or ""))) for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(StructType([StructField("text", StringType()), *(StructField(n, LongType()) for n in _COUNTS)]))
def _repaired(texts: pa.Array, repairs: pa.Array) -> pa.Array:
    told = [repaired_text(t or "", {x["word"]: x["repaired"] for x in r or ()}) for t, r in zip(texts.to_pylist(), repairs.to_pylist(), strict=True)]
    columns = [pa.array([x[0] for x in told], pa.string()), *(pa.array([x[i] for x in told], pa.int64()) for i in range(1, 5))]
    return pa.StructArray.from_arrays(columns, ["text", *_COUNTS])


def repaired(docs: DataFrame, lexicon_: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, swapped, glued, junk, collapsed) of every row, line by line.

    Only words that may have a repair are shuffled, and of the texts those that hold
    Persian, to meet their words' repairs; all others are worked on where they are read.
    """
    ship_package(docs.sparkSession)
    told = docs.select(key, F.col(text).alias("text"))
    persian = F.coalesce(F.col("text").rlike(MAY_BE_PERSIAN), F.lit(False))
    asked = told.where(persian).select(F.col(key).alias("key__"), F.explode(_damaged("text")).alias("word"))
    met = asked.join(word_repairs(asked, lexicon_), "word").groupBy("key__").agg(F.collect_set(F.struct("word", "repaired")).alias("repairs"))
    some = told.where(persian).join(met, F.col(key).eqNullSafe(F.col("key__")), "left").select(key, "text", "repairs")
    rest = told.where(~persian).withColumn("repairs", F.expr("cast(null as array<struct<word: string, repaired: string>>)"))
    each = [df.select(key, _repaired("text", "repairs").alias("r")) for df in (rest, some)]
    return each[0].unionByName(each[1]).select(key, "r.text", *(f"r.{n}" for n in _COUNTS))


def looks_corrupted(text: Column, known: Column, least: int = 3, words: int = 400) -> Column:
    """Three unknown words or more with a turned pair among the text's first words (that many are the test's definition)."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}{ZWNJ}]+"), lambda w: w != "")
    odd = F.filter(F.slice(split, 1, words), lambda w: w.rlike("ال|رت|نت|رب") & ~F.array_contains(known, F.replace(w, F.lit(ZWNJ), F.lit(""))))
    return F.size(odd) >= least


def totals(reports: DataFrame) -> DataFrame:
    return reports.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("swapped", "glued", "junk", "collapsed")))


__all__ = ["lexicon", "looks_corrupted", "lookups", "repaired", "repaired_word", "swaps", "tidy", "totals", "word_repairs"]
