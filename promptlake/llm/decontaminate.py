"""Benchmark decontamination with one Aho-Corasick automaton (operator 3).

Benchmark texts and documents are lower-cased (A-Z) and cut into words of digits,
letters and characters beyond ASCII. Every 13 consecutive item words form a
window (a shorter item is one window); the automaton finds all windows in one
scan of the document's words, and each word inside a found window is hit. Hits
are mapped back to code-point offsets of the original text. The automaton's symbols
are whole words, numbered by the benchmark's own vocabulary.

The windows travel to the tasks as text, and each Python worker builds the
automaton once and keeps one at a time. Their size is measured first. A benchmark beyond
``max_window_words`` is screened: windows become 64-bit hashes (8 bytes each instead of
hundreds), one pass over the documents finds which hashes occur at all, and
the one automaton is built of those windows alone, which a join has given back their text. The screen loses
nothing, since equal words have equal hashes, and what it finds too much the automaton doesn't match.
Only if even the windows that occur are beyond the bound do they go in several sets, each within it.

Defined results: null and wordless texts have no words, no hits and are clean;
null or wordless items match nothing; an item without an id hits words, but is no
named item; equal windows of several items count for each of them; repeated rows
are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import xxhash
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import LOWER, WORD, discard, hidden, stored

WINDOW = 13
#: Words of windows (each window's counted) in one automaton, which takes some 50 bytes for each.
MAX_WINDOW_WORDS = 4_000_000
#: Hashes of windows (8 bytes each) that one pass looks for.
MAX_SCREENED = 16_000_000
_NORMAL = np.where(WORD, LOWER, 32).astype(np.uint8).tobytes()
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Words remembered with their hash in a task, and what a window's hash is built with.
_KNOWN, _BASE = 1 << 18, np.uint64(0x9E3779B97F4A7C15)

_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _RANGES), ("words", _RANGES)])
_DDL = (
    "struct<n_words: bigint, n_hit: bigint, items: array<string>, "
    "spans: array<struct<start: bigint, end: bigint>>, words: array<struct<start: bigint, end: bigint>>>"
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(items: list[tuple[str | None, str]], size: int = WINDOW) -> dict[str, list[str]]:
    """Each window's text and the named items that hold it."""
    found = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found[b" ".join(w[i : i + size]).decode()].add(item)
    return {w: sorted(held - {None}) for w, held in found.items()}


class Matcher:
    """An automaton over word numbers, built in each Python worker from the windows it was sent."""

    #: The last one built, with its key: a worker keeps no other.
    last: tuple[str, Matcher] | None = None

    def __init__(self, found: dict[str, list[str]]):
        self.number: dict[bytes, int] = {}
        self.shortest = min((w.count(" ") + 1 for w in found), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in found.items():
            split = window.encode().split()
            self.automaton.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in split), (len(split), items))
        if found:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, found) -> Matcher:
        """The matcher of this key; `found` is called for its windows if it isn't the last one."""
        if cls.last is None or cls.last[0] != key:
            cls.last = None
            cls.last = key, cls(found())
        return cls.last[1]

    def hits(self, split: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(last word's place, words, items) of every window found.

        Only runs of words that windows have, as long as the shortest window, can hold one.
        """
        if not self.shortest:
            return []
        numbers = list(map(self.number.get, split, repeat(0)))
        known = np.fromiter(numbers, np.int64, len(numbers)) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        return [
            (start + at, *value)
            for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True)
            for at, value in self.automaton.iter(tuple(numbers[start:end]))
        ]


def judge(text: str | None, matcher: Matcher, before: dict | None = None) -> dict:
    """What the matcher finds in a text, added to what was found `before`."""
    split = words(text)
    hits = matcher.hits(split) if split else []
    known = before or {"items": [], "words": []}
    if not hits and not known["words"]:
        return {"n_words": len(split), "n_hit": 0, "items": [], "spans": [], "words": []}
    change = np.zeros(len(split) + 1, np.int64)
    last = np.array([at for at, _, _ in hits], np.int64)
    np.add.at(change, last + 1 - np.array([n for _, n, _ in hits], np.int64), 1)
    np.add.at(change, last + 1, -1)
    for r in known["words"]:
        change[r["start"]] += 1
        change[r["end"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    at = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    return {
        "n_words": len(split),
        "n_hit": int(hit.sum()),
        "items": sorted({i for _, _, items in hits for i in items} | set(known["items"])),
        "spans": [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs],
        "words": [{"start": a, "end": b} for a, b in runs],
    }


def _scanned(key: str, sent, text, before=None):
    """The result of one set's scan of a text column, added to what earlier scans found."""

    @F.arrow_udf(_DDL)
    def first(texts: pa.Array) -> pa.Array:
        matcher = Matcher.of(key, lambda: sent.value)
        return pa.array([judge(t.as_py(), matcher) for t in texts], _RESULT)

    @F.arrow_udf(_DDL)
    def further(texts: pa.Array, before: pa.Array) -> pa.Array:
        matcher = Matcher.of(key, lambda: sent.value)
        return pa.array([judge(t.as_py(), matcher, b.as_py()) for t, b in zip(texts, before, strict=True)], _RESULT)

    return first(text) if before is None else further(text, before)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    max_window_words: int = MAX_WINDOW_WORDS,
    max_screened: int = MAX_SCREENED,
    as_column: str = "contamination",
) -> DataFrame:
    """docs with a struct column: n_words, n_hit, items (sorted ids), spans of the original text (code points), words (places of hit words)."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(_WORDS.pattern)))).first()[0] or 0
    if int(n_words) * size <= max_window_words:
        sets = iter([windows([(r.item, r.text) for r in items.collect()], size)])
        n_sets, kept = 1, None
    else:
        kept = occurring(docs, items, text, size, max_screened)
        held = kept.agg(F.sum("n")).first()[0] or 0
        n_sets = max(1, -(-int(held) // max_window_words))
        of = lambda k: kept.where(F.pmod(F.xxhash64("window"), F.lit(n_sets)) == k) if n_sets > 1 else kept
        sets = ({r.window: sorted(r["items"]) for r in of(k).toLocalIterator()} for k in range(n_sets))
    told, part, older = docs, hidden(docs, "found"), None
    for k, found in enumerate(sets):
        key = hashlib.sha256(repr(sorted(found.items())).encode()).hexdigest()
        sent = context.broadcast(found)

        name = as_column if k == n_sets - 1 else part
        told = told.withColumn(name, _scanned(key, sent, F.col(text), F.col(part) if k else None))
        if k < n_sets - 1:
            told = stored(told, "contamination")
            sent.destroy()
            if older is not None:
                discard(older)
            older = told
    if kept is not None:
        discard(kept)
    return told.drop(part)


def _hashes(split: list[bytes], n: int, known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of every n words that follow one another."""
    if len(split) < n:
        return np.zeros(0, np.uint64)
    for w in split:
        if w not in known:
            if len(known) > _KNOWN:
                known.clear()
            known[w] = xxhash.xxh64_intdigest(w)
    one = np.array([known[w] if w in known else xxhash.xxh64_intdigest(w) for w in split], np.uint64)
    total = np.zeros(len(split) - n + 1, np.uint64)
    for i in range(n):
        total = total * _BASE + one[i : len(split) - n + 1 + i]
    return total * _BASE + np.uint64(n)


def _window_rows(size: int):
    """Batches of (item, text) to (h, n, window, item) of every window."""

    def rows(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                if w:
                    n = min(size, len(w))
                    h = _hashes(w, n, known).view(np.int64)
                    said = [b" ".join(w[i : i + n]).decode() for i in range(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([n] * len(h), pa.int32()), pa.array(said, pa.string()), pa.array([item] * len(h), pa.string())], names=["h", "n", "window", "item"])

    return rows


def _screen(sent):
    """Batches of texts to the hashes (h) of windows that occur in them, each once a batch."""

    def look(batches):
        lengths, wanted = sent.value
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                split = words(text)
                for n in lengths:
                    h = _hashes(split, n, known)
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    found.append(h[wanted[at] == h])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["h"])

    return look


def occurring(docs: DataFrame, items: DataFrame, text: str = "text", size: int = WINDOW, max_screened: int = MAX_SCREENED) -> DataFrame:
    """(window, n, items) of the windows of items (item, text) whose hashes occur in the documents; stored."""
    context = docs.sparkSession.sparkContext
    every = stored(items.select("item", "text").mapInArrow(_window_rows(size), "h bigint, n int, window string, item string"), "decontaminate-windows")
    lengths = [r.n for r in every.select("n").distinct().collect()]  # at most `size` of them
    hashes = every.select("h").distinct()
    n_passes = -(-hashes.count() // max_screened)
    parts = []
    for k in range(n_passes):
        some = (hashes.where(F.pmod("h", F.lit(n_passes)) == k) if n_passes > 1 else hashes).toArrow()["h"].to_numpy()
        sent = context.broadcast((lengths, np.sort(some.view(np.uint64))))
        parts.append(docs.select(F.col(text).alias("text")).mapInArrow(_screen(sent), "h bigint"))
    if not parts:
        return stored(every.select("window", "n", F.array("item").alias("items")).where("false"), "decontaminate-found")
    met = reduce(DataFrame.unionByName, parts).distinct()
    told = every.join(met, "h", "left_semi").groupBy("window").agg(F.first("n").alias("n"), F.collect_set("item").alias("items"))
    found = stored(told, "decontaminate-found")
    discard(every)
    return found


def contaminated(found: str = "contamination"):
    """Five in a hundred of the words, and at least one, are hit."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def cut_spans(text: str, found: str = "contamination"):
    """The text without the hit spans (native)."""
    spans = F.col(f"{found}.spans")
    state = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(
            F.concat(s["kept"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("kept"),
            x["end"].alias("at"),
        ),
        lambda s: F.concat(s["kept"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without contaminated rows, same columns."""
    name = hidden(docs, "contamination")
    return contamination(docs, benchmark, as_column=name, **options).where(~contaminated(name)).drop(name)


__all__ = ["clean", "contaminated", "contamination", "cut_spans", "judge", "occurring", "windows"]
