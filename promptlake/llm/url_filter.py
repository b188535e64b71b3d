"""URL filter by rules and a weighted vocabulary (operator 8).

Rules of (verdict, host, path) fit a host and all its subdomains where the url's
path starts with the rule's; the longest fitting rule decides. Where none fits,
one Aho-Corasick automaton counts the vocabulary's terms in host and path, their
%-escapes decoded and in small letters: a strict term blocks, or several different
soft terms of one language whose weights reach ``LIMIT`` together. A term counts only
between characters that are no letters or digits of any script, so that `bet` is
not found in `alphabet`, nor in `béta`; and not inside an allowed context, such as
`adult education` or `casino royale`.

The vocabulary is a list of (language, weight, terms) and the contexts are a list of
phrases; the caller may replace both. A weight of ``LIMIT`` or more is strict. Soft terms of
different languages don't add up, since a word that is soft in one is often plain in another; a host whose
suffix names a language counts soft terms of that one and of English only.

Defined results: null urls and urls without `://` have empty host and path and
are allowed by the vocabulary; terms repeated in one url count once, also if several
languages have them; an escape that is no UTF-8 counts as a boundary; a url of any length is
read whole.
"""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import hidden

#: Weights that together block; a term of this weight blocks alone.
LIMIT = 100

# The vocabulary by language and weight.
VOCABULARY = [
    ("en", 100, "camgirl camgirls casino casinos escorts hentai phishing porn porno pornhub viagra cialis warez xvideos xxx"),
    ("en", 60, "adult betting escort gamble gambling jackpot keygen nude poker roulette sex slots sportsbook torrent"),
    ("en", 50, "bet bets bonus crack cracked hookup loan loans pills popup promo serial spam spins toplist"),
    ("en", 40, "cheap click clicks coupon coupons dating deal deals discount discounts payday pill win winner"),
    ("en", 20, "ads download farm free games offer offers online sale spin track tracker"),
    ("de", 100, "hurenbock pornos sexfilme raubkopie"),
    ("de", 60, "erotik glücksspiel nackt potenzmittel spielhalle sportwetten"),
    ("de", 50, "gewinnspiel partnersuche wette wetten"),
    ("de", 40, "gratis kredit kredite rabatt schnäppchen werbung"),
    ("fr", 100, "hameçonnage pornographie"),
    ("fr", 60, "érotique erotique libertin loterie pari sexe"),
    ("fr", 50, "gagner paris promo rencontre rencontres"),
    ("fr", 40, "argent crédit credit gratuit gratuite remise"),
    ("fr", 20, "cadeau jeux promotion publicité télécharger"),
    ("es", 100, "pornografía pornografia prostitutas"),
    ("es", 60, "apuesta apuestas desnuda erótico erotico lotería sexo"),
    ("es", 50, "ganar premio préstamo"),
    ("es", 40, "barato crédito descuento gratis oferta ofertas regalo"),
    ("es", 20, "descarga publicidad"),
]
# Phrases inside which no term counts.
CONTEXTS = [
    "adult education", "adult literacy", "adult learning", "adult learners", "adult social care", "adult fiction", "young adult", "sex education", "sex ratio", "sex discrimination", "same sex", "sex chromosome",
    "casino royale", "casino film", "casino 1995", "monte carlo casino history", "free software", "free will", "free speech", "free press", "free trade", "free walking tour", "duty free", "gluten free", "phishing awareness",
    "phishing prevention", "report phishing", "about phishing", "anti phishing", "poker face", "roulette wheel history", "student loans", "student loan", "home loan", "nude painting", "nude art", "alpha bet", "win win", "deal with", "big deal",
    "spam filter", "anti spam", "spam folder", "serial number", "serial port", "drug crack", "torrent river", "dating methods", "carbon dating", "radiometric dating", "gambling addiction", "problem gambling", "gambling act", "gambling commission",
    "mile high promo", "jeux olympiques", "paris 2024", "ville de paris", "crédit agricole", "premio nobel", "premio cervantes",
]
# Languages of hosts' suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

Terms = list[tuple[str, int, str]]
_LETTER = r"[\p{L}\p{N}]"


def listed(terms: Terms = VOCABULARY) -> dict[str, dict[str, int]]:
    """The weight of each term by language."""
    found: dict[str, dict[str, int]] = {}
    for language, weight, words in terms:
        for term in words.split():
            own = found.setdefault(term, {})
            own[language] = max(weight, own.get(language, 0))
    return found


def vocabulary(terms: Terms = VOCABULARY) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weights in listed(terms).items():
        found.add_word(term, (term, weights))
    found.make_automaton()
    return found


def context_pattern(contexts: list[str]) -> str:
    """One pattern of all contexts between boundaries, the longest first; words of one may be parted by any marks."""
    said = sorted((c.split() for c in contexts), key=lambda w: (-len(" ".join(w)), w))
    between = _LETTER.replace("[", "[^", 1) + "+"
    return f"(^|{_LETTER.replace('[', '[^', 1)})(?:{'|'.join(between.join(map(regex.escape, w)) for w in said)})({_LETTER.replace('[', '[^', 1)}|$)"


def _inside(c: str) -> bool:
    """Whether a character continues a word: letters and numbers of any script."""
    return unicodedata.category(c)[0] in "LN"


def terms_in(text: str, automaton: ahocorasick.Automaton) -> dict[str, dict[str, int]]:
    """The different terms that stand between boundaries, with their weights by language."""
    found = {}
    for end, (term, weights) in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _inside(text[start - 1])) and (end + 1 == len(text) or not _inside(text[end + 1])):
            found[term] = weights
    return found


def weighed(found: dict[str, dict[str, int]], language: str | None) -> tuple[int, int, int]:
    """(strict terms, soft terms, the largest sum of soft weights of a language that counts, one term alone being no sum)."""
    strict = sum(max(w.values()) >= LIMIT for w in found.values())
    soft = [w for w in found.values() if max(w.values()) < LIMIT]
    sums: dict[str, list[int]] = {}
    for w in soft:
        for of, weight in w.items():
            if language is None or of in (language, "en"):
                sums.setdefault(of, []).append(weight)
    return strict, len(soft), max((sum(x) for x in sums.values() if len(x) > 1), default=0)


def _ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url):
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules: list[tuple[str, str, str]]):
    """struct(rule, verdict) of the longest fitting rule, or null. Rules are few and fixed by the caller."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, of, start in reversed(longest_first):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(
    df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", terms: Terms = VOCABULARY, contexts: list[str] = CONTEXTS, suffixes: dict[str, str] = SUFFIXES, as_column: str = "judged"
) -> DataFrame:
    """df with a struct column: host, path, rule, verdict, strict and soft (the counted terms) and weight (of soft terms of one language)."""
    built: list[tuple[ahocorasick.Automaton, regex.Pattern | None]] = []

    @F.arrow_udf("struct<strict: int, soft: int, weight: int>")
    def count(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if not built:
            built.append((vocabulary(terms), regex.compile(context_pattern(contexts)) if contexts else None))
        automaton, allowed = built[0]
        told = []
        for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            said = unquote(f"{h}{p}").lower()
            for _ in range(2 if allowed else 0):  # contexts that follow one another share a boundary
                said = allowed.sub(r"\1/\2", said)
            told.append(weighed(terms_in(said, automaton), suffixes.get(h.rpartition(".")[2])))
        return pa.StructArray.from_arrays([pa.array([t[i] for t in told], pa.int32()) for i in range(3)], ["strict", "soft", "weight"])

    h, p = host(F.col(url)), path(F.col(url))
    at, rest, rule, counts = (hidden(df, name) for name in ("host__", "path__", "rule__", "counts__"))
    judged = df.withColumn(at, h).withColumn(rest, p)
    judged = judged.withColumn(rule, fitting_rule(F.col(at), F.col(rest), rules)).withColumn(counts, count(at, rest))
    by_terms = F.when((F.col(f"{counts}.strict") > 0) | (F.col(f"{counts}.weight") >= LIMIT), "block").otherwise("allow")
    return judged.withColumn(
        as_column,
        F.struct(
            F.col(at).alias("host"),
            F.col(rest).alias("path"),
            F.col(f"{rule}.rule").alias("rule"),
            F.coalesce(F.col(f"{rule}.verdict"), by_terms).alias("verdict"),
            F.col(f"{counts}.strict").alias("strict"),
            F.col(f"{counts}.soft").alias("soft"),
            F.col(f"{counts}.weight").alias("weight"),
        ),
    ).drop(at, rest, rule, counts)
