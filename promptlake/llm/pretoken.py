"""The word pattern of the byte-level vocabularies, for Python's re.

The tokenizer library reads Unicode 16 classes; the interpreter may know an older
version, so the ranges that version 16 added are listed here.
"""

from __future__ import annotations

import re
import sys
import unicodedata

# Letters (L) and numbers (N) that Unicode 16 added to 15.1.
ADDED = (
    "L 1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 1138B-1138B 1138E-1138E "
    "11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF "
    "1E5D0-1E5ED 1E5F0-1E5F0 N 10D40-10D49 11380-11389 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
)


def _ranges() -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "S": []}
    last = ""
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        kind = "S" if chr(c).isspace() and not 0x1C <= c <= 0x1F else kind if kind in "LN" else ""
        if kind and kind == last:
            found[kind][-1] = (found[kind][-1][0], c)
        elif kind:
            found[kind].append((c, c))
        last = kind
    kind = ""
    for part in ADDED.split():
        if part in found:
            kind = part
        else:
            found[kind].append(tuple(int(x, 16) for x in part.split("-")))
    return found


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _compiled(letter: str, number: str, blank: str) -> re.Pattern:
    """Contractions, letters, numbers, other signs (each with one blank before), and blanks."""
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


_full: re.Pattern | None = None
#: The same classes below U+0100, where a bitmap decides.
_latin = _compiled("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0")


def pieces(text: str) -> list[str]:
    """The pieces of a text, which joined give the text."""
    global _full
    try:
        text.encode("latin-1")
        return _latin.findall(text)
    except UnicodeEncodeError:
        if _full is None:
            _full = _compiled(*map(_class, _ranges().values()))
        return _full.findall(text)
