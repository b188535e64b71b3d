"""Dictionaries of any size: all terms and their spellings found in one scan of a text.

Terms are brought to a canonical form in which the letters of both alphabets are one and
blanks or joiners are single blanks, and put into one automaton. A text gets the
same form with a map of offsets back, so that hits are spans of the original. What
the form makes alike too much (a joiner in place of a hyphen is none in place of a
blank) is tested again on the original by the term's own pattern. Of hits that
overlap the leftmost counts, and of those that begin together the longest term.

Each Python worker builds the automaton once, from terms that are broadcast in sets
of at most MAX_TERMS; hits of several sets meet before they are chosen from.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from promptlake.functions.patterns import BLANKS, ZWNJ

#: Terms in one automaton, some 100 bytes each.
MAX_TERMS = 500_000
#: Hyphens of a term whose spellings are listed; a term with more is found by its longest part without one.
MAX_HYPHENS = 4
_ALIKE = str.maketrans({"ي": "ی", "ك": "ک"})
_WIDE = regex.compile(f"[{BLANKS}{ZWNJ}]{{2,}}")
_GAP = regex.compile(f"(?! )[{BLANKS}{ZWNJ}]")
_FIELDS = ("start", "end", "size", "place", "kind")
_CANDIDATE = f"array<struct<{', '.join(f'{n}: int' for n in _FIELDS)}>>"


def _low(text: str) -> str:
    """Small letters, one for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def canonical(text: str) -> tuple[str, list[int]]:
    """(canonical text, where each of its characters begins in the original, and the original's end)."""
    low = _low(text if text.isascii() else text.translate(_ALIKE))
    out, at, start = [], [], 0
    # a single blank keeps its place; only wider gaps move what follows
    for m in _WIDE.finditer(low):
        out.append(low[start : m.start()])
        at.extend(range(start, m.start() + 1))
        out.append(" ")
        start = m.end()
    out.append(low[start:])
    at.extend(range(start, len(low) + 1))
    return _GAP.sub(" ", "".join(out)), at


@cache
def spelled(term: str) -> regex.Pattern:
    """A term as it may stand in a text."""
    loose = {"ی": "[یي]", "ک": "[کك]", " ": f"[{BLANKS}{ZWNJ}]+", "-": f"[\\-{ZWNJ}]?"}
    return regex.compile("".join(loose.get(c) or regex.escape(c) for c in term), regex.IGNORECASE)


def forms(term: str) -> set[str]:
    """The canonical forms of a term's spellings."""
    parts = term.split("-")
    if len(parts) - 1 > MAX_HYPHENS:
        parts = [max(parts, key=len)]
    listed = {"".join(x for pair in zip(parts, (*gaps, ""), strict=True) for x in pair) for gaps in product(("-", " ", ""), repeat=len(parts) - 1)}
    return {f for f in (canonical(x)[0].strip() for x in listed) if f}


class Lexicon:
    """An automaton of a set of terms: (kind, term, place in the list) each."""

    #: The last one built, with its key: a worker keeps no other.
    last: tuple[str, Lexicon] | None = None

    def __init__(self, terms: list[tuple[int, str, int]]):
        self.automaton = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, str, int, bool]]] = {}
        for kind, term, place in terms:
            # such a term stands wherever its only form does in an ASCII text
            sure = term.isascii() and "-" not in term and canonical(term)[0] == term.lower()
            for form in forms(term):
                of.setdefault(form, []).append((kind, term, place, sure))
        for form, listed in of.items():
            self.automaton.add_word(form, (len(form), listed))
        if of:
            self.automaton.make_automaton()
        self.some = bool(of)

    @classmethod
    def of(cls, key: str, terms) -> Lexicon:
        if cls.last is None or cls.last[0] != key:
            cls.last = None
            cls.last = key, cls(terms())
        return cls.last[1]

    def candidates(self, text: str) -> list[dict]:
        """Every place where a term stands, tested on the original."""
        if not self.some:
            return []
        low, at = canonical(text)
        found = {}
        plain = text.isascii()
        for end, (size, listed) in self.automaton.iter(low):
            start = at[end - size + 1]
            for kind, term, place, sure in listed:
                if sure and (plain or text[start : at[end] + 1].isascii()):
                    found[start, at[end] + 1, len(term), place, kind] = None
                    continue
                # hyphens that a term begins with may stand before what the form holds
                lead = min(start, len(term) - len(term.lstrip("-")))
                while lead and not set(text[start - lead : start]) <= {"-", ZWNJ}:
                    lead -= 1
                for k in range(lead + 1):  # a hyphen may be taken by the hit before
                    m = spelled(term).match(text, start - k)
                    if m and m.end() > m.start():
                        found[m.start(), m.end(), len(term), place, kind] = None
        return [dict(zip(_FIELDS, x, strict=True)) for x in found]


def chosen(found: list[dict]) -> list[dict]:
    """Of each kind the leftmost candidates that don't overlap, the longest term of those that begin together, of equal ones that listed first; kinds in order."""
    out, kind, free = [], None, 0
    for x in sorted(found, key=lambda x: (x["kind"], x["start"], -x["size"], x["place"])):
        if x["kind"] != kind:
            kind, free = x["kind"], 0
        if x["start"] >= free:
            out.append(x)
            free = x["end"]
    return out


def term_spans(text: Column, terms: list[tuple[int, str]], max_terms: int = MAX_TERMS) -> Column:
    """array<struct<start, end, text, kind>> of a text's terms; kinds are numbered, and in that order.

    Terms are trimmed; those of fewer than two characters, or of nothing but hyphens and blanks, are left out. Offsets count code points.
    """
    kept = [(k, t, i) for i, (k, t) in enumerate(dict.fromkeys((k, t.strip()) for k, t in terms if len(t.strip()) >= 2))]
    context = SparkSession.getActiveSession().sparkContext

    def scan(part: list[tuple[int, str, int]]) -> Column:
        key, sent = hashlib.sha256(repr(part).encode()).hexdigest(), context.broadcast(part)

        @F.arrow_udf(_CANDIDATE)
        def each(texts: pa.Array) -> pa.Array:
            lexicon = Lexicon.of(key, lambda: sent.value)
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in _FIELDS]))
            return pa.array([lexicon.candidates(t or "") for t in texts.to_pylist()], kind)

        return each(text)

    @F.arrow_udf("array<struct<start: int, end: int, text: string, kind: int>>")
    def choose(texts: pa.Array, found: pa.Array) -> pa.Array:
        told = [[{"start": x["start"], "end": x["end"], "text": t[x["start"] : x["end"]], "kind": x["kind"]} for x in chosen(f or [])] for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
        return pa.array(told, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("kind", pa.int32())])))

    parts = [scan(kept[i : i + max_terms]) for i in range(0, len(kept), max_terms)]
    return choose(text, F.concat(*parts) if parts else F.expr(f"cast(array() as {_CANDIDATE})"))


__all__ = ["Lexicon", "canonical", "chosen", "forms", "spelled", "term_spans"]
