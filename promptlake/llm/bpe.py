"""Byte-pair encoding and decoding (operator 4).

A piece of text becomes a doubly linked list of symbols. A priority queue holds
the mergeable neighbours by rank (then by place); each step takes the best one,
skips it if either symbol has changed since, merges, and queues the two new
neighbours. Decoding concatenates the vocabulary's byte strings.

The vocabulary file is a parameter; it is read on the driver and sent to the
tasks by broadcast (its size is checked). Each Python worker keeps one codec and
remembers the ids of pieces it has met, up to ``memory`` bytes: what half of it holds
stays until another half is full, and what is met again meanwhile stays longer.

Defined results: null counts as empty; an empty text has no ids; special tokens
inside a text are recognised as the library does by default; texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.pretoken import pieces

MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of pieces and their ids that a worker remembers, each entry's own upkeep included; longer pieces aren't kept.
MEMORY_BYTES, ENTRY_BYTES, LONGEST = 16 << 20, 160, 64


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The ranks of a symbol that no merge begins with.
_NONE: dict[int, int] = {}


class Codec:
    """Encodes and decodes with one byte-level vocabulary."""

    #: The last one built, with its key: a worker keeps no other.
    last: tuple[str, Codec] | None = None

    def __init__(self, spec: dict, memory: int = MEMORY_BYTES):
        vocabulary = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        to_byte = {c: b for b, c in byte_letters().items()}
        self.special = special
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocabulary[c] for _, c in sorted(byte_letters().items())]
        #: of each symbol the rank of its merge with a right neighbour, and what each rank joins
        self.ranks: list[dict[int, int]] = [_NONE] * len(self.bytes_of)
        self.rule: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rule.append(vocabulary[left + right])
            i = vocabulary[left]
            if self.ranks[i] is _NONE:
                self.ranks[i] = {}
            self.ranks[i][vocabulary[right]] = rank
        #: pieces and their ids: those met of late, and those met before; each takes up to half the memory
        self.memory, self.used, self.known, self.older = memory, 0, {}, {}

    @classmethod
    def of(cls, key: str, spec: str) -> Codec:
        if cls.last is None or cls.last[0] != key:
            cls.last = None
            cls.last = key, cls(json.loads(spec))
        return cls.last[1]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A queued number is a rank, then a place in its low bits, so ranks order it, then places."""
        symbols = list(map(self.byte_id.__getitem__, piece))
        n, ranks, rule = len(symbols), self.ranks, self.rule
        if n < 2:
            return symbols
        bits, pop, push = n.bit_length(), heapq.heappop, heapq.heappush
        low = (1 << bits) - 1
        # what is queued for each symbol with its right neighbour, as it is now: a queued number that differs is stale
        now, queue, left = [None] * n, [], symbols[0]
        for i in range(1, n):
            r = ranks[left].get(left := symbols[i])
            if r is not None:
                now[i - 1] = r = r << bits | i - 1
                queue.append(r)
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        symbols.append(-1)  # the end, which joins nothing
        while queue:
            top = pop(queue)
            i = top & low
            if now[i] != top:
                continue
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            joined = symbols[i] = rule[top >> bits]
            symbols[j], now[j] = -1, None
            r = ranks[joined].get(symbols[k])
            if r is None:
                now[i] = None
            else:
                now[i] = r = r << bits | i
                push(queue, r)
            h = before[i]
            if h >= 0:
                r = ranks[symbols[h]].get(joined)
                if r is None:
                    now[h] = None
                else:
                    now[h] = r = r << bits | h
                    push(queue, r)
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> bytes:
        parts = pieces(text)
        if 2 * self.used > self.memory:
            self.older, self.known, self.used = self.known, {}, 0
        known, older, long, used = self.known, self.older, {}, 0
        for p in set(parts).difference(known):
            raw, ids = p.encode("utf-8", "surrogatepass"), older.get(p)
            if ids is None:
                merged = self.merge(raw)
                ids = struct.pack(f"<{len(merged)}I", *merged)
                if len(raw) > LONGEST:
                    long[p] = ids
                    continue
            known[p] = ids
            used += len(raw) + len(ids) + ENTRY_BYTES
        self.used += used
        if not long:
            return b"".join(map(known.__getitem__, parts))
        return b"".join(long[p] if p in long else known[p] for p in parts)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.split_special is None or not self.split_special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split_special.split(text)]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


def read_spec(path: str) -> str:
    """The vocabulary file's JSON text, its size within the bound."""
    with open(path, "rb") as f:
        spec = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than may be sent to every task")
    return spec.decode()


def _codec(df: DataFrame, path: str):
    context = df.sparkSession.sparkContext
    spec = read_spec(path)
    sent, key = context.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()
    return lambda: Codec.of(key, sent.value)


def encode(df: DataFrame, path: str, text: str = "text", as_column: str = "ids") -> DataFrame:
    """df with the array of token ids of each text."""
    codec = _codec(df, path)

    @F.arrow_udf("array<int>")
    def f(texts: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([c.encode(t.as_py()).astype(np.int32) for t in texts], pa.list_(pa.int32()))

    return df.withColumn(as_column, f(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", as_column: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; a null array gives an empty text."""
    codec = _codec(df, path)

    @F.arrow_udf("string")
    def f(rows: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([c.decode(r.as_py() or ()) for r in rows], pa.string())

    return df.withColumn(as_column, f(F.col(ids)))


_ROUND = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(df: DataFrame, path: str, text: str = "text", as_column: str = "coded") -> DataFrame:
    """df with a struct of the number of ids and the digests of ids and of the decoded text.

    Encodes and decodes in one visit, so neither ids nor texts leave the task.
    """
    codec = _codec(df, path)

    def one(c: Codec, text: str | None) -> dict:
        ids = c.encode(text)
        return {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256(c.decode(ids).encode()).hexdigest(),
        }

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def f(texts: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([one(c, t.as_py()) for t in texts], _ROUND)

    return df.withColumn(as_column, f(F.col(text)))
