"""Target-distribution importance resampling by external sort-count (operator 12).

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters
beyond ASCII; each run of `shortest` to `longest` words is a feature and falls into
the bucket crc32 modulo `buckets`. The buckets of many texts are written one after
the other as a packed stream of uint16 with the offset at which each text begins, a table
that is later read twice: sorted and run-length encoded it gives the counts, and
with the gain of each bucket, log of the target's share over the corpus's, gathered
over the stream and summed between the offsets (np.add.reduceat), each text's weight.
A Gumbel key by hash of the id makes the draw one without replacement.

Only counts and gains (`buckets` rows) come to the driver and go to the tasks. A stream
is closed after the text with which it reaches PIECE features, so a row holds less than
PIECE numbers and those of one text, which never take more bytes than the text.

Defined results: null and wordless texts have no features and weight 0; a null id hashes the empty id and
comes first among equal scores; repeated rows are scored and drawn one by one; an empty corpus or target gives
all buckets their smoothed share alike; the draw is none if fewer than 100 / share rows are long enough.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import LOWER, WORD, discard, ranked, stored, utf8

#: Features at which a stream is closed.
PIECE = 1 << 20
#: Features remembered with their bucket in a task.
KNOWN = 1 << 17
#: Bytes of a text cut into words at once, a longer word excepted.
PART = 1 << 18
_NORMAL = np.where(WORD, LOWER, 32).astype(np.uint8).tobytes()


class Buckets(dict):
    """A feature's bucket, computed once; emptied when it holds KNOWN."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            self[feature] = found
        return found


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    low, start = text.translate(_NORMAL), 0
    while start < len(low):
        stop = len(low)
        if start + PART < stop:
            edge = low.rfind(b" ", start, start + PART)
            edge = edge if edge >= 0 else low.find(b" ", start + PART)
            stop = edge + 1 if edge >= 0 else stop
        yield low[start:stop].split()
        start = stop


def bucket_runs(text: bytes, shortest: int, longest: int, found: Buckets) -> tuple[list[np.ndarray], int]:
    """The buckets of a text's features, in parts, and how many words it has."""
    before: list[bytes] = []
    parts, n_words = [], 0
    for words in word_parts(text):
        n_words += len(words)
        both = before + words
        for n in range(shortest, longest + 1):
            # the runs that end in this part
            runs = words if n == 1 else [b" ".join(both[i : i + n]) for i in range(max(0, len(before) - n + 1), len(both) - n + 1)]
            parts.append(np.fromiter(map(found.__getitem__, runs), np.uint16, len(runs)))
        before = both[max(0, len(both) - longest + 1) :] if longest > 1 else []
    return parts, n_words


def _packed(shortest: int, longest: int, buckets: int):
    """Batches of (key, text) to rows of stream, keys, n_words, offsets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(buckets)
        parts: list[np.ndarray] = []
        keys, words, starts, held = [], [], [], 0
        kind = pa.null()

        def closed() -> pa.RecordBatch:
            stream = np.concatenate([*parts, np.zeros(0, np.uint16)]).astype("<u2").tobytes()
            arrays = [pa.array([stream], pa.binary()), pa.array([keys], pa.list_(kind)), pa.array([words], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["stream", "keys", "n_words", "offsets"])

        for batch in batches:
            kind = batch.column(0).type
            data, offsets = utf8(batch.column(1))
            for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                runs, n_words = bucket_runs(data[a:b].tobytes(), shortest, longest, found)
                keys.append(key)
                words.append(n_words)
                starts.append(held)
                parts += runs
                held += sum(map(len, runs))
                if held >= PIECE:
                    yield closed()
                    parts, keys, words, starts, held = [], [], [], [], 0
        if keys:
            yield closed()

    return pack


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """Packed streams of the texts' buckets, with the keys, word counts and offsets of the texts in each."""
    if not 0 < buckets <= 1 << 16 or not 0 < shortest <= longest:
        raise ValueError("buckets must fit 16 bits, and runs have a word at least")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"stream binary, keys array<{kind}>, n_words array<bigint>, offsets array<bigint>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_packed(shortest, longest, buckets), schema)


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of each stream: sorted, then run-length encoded."""
    for batch in batches:
        for stream in batch.column(0).to_pylist():
            ordered = np.sort(np.frombuffer(stream, "<u2"))
            edges = np.flatnonzero(np.diff(ordered.astype(np.int64), prepend=-1, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(ordered[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges), pa.int64())], names=["bucket", "n"])


def counts(packed: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs: at most `buckets` rows come to the driver."""
    found = packed.select("stream").mapInArrow(run_lengths, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = [0] * buckets
    for r in found:
        total[r.bucket] = r.n
    return total


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all = sum(corpus) + len(corpus), sum(target) + len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _gathered(gain: np.ndarray):
    """Streams to (key, n_words, n_features, weight) of every text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                got = gain[np.frombuffer(batch.column(0)[i].as_py(), "<u2")]
                keys, words, offsets = (batch.column(k)[i].values for k in (1, 2, 3))
                at = offsets.to_numpy()
                n = np.diff(at, append=len(got))
                total, full = np.zeros(len(at), np.int64), n > 0
                if full.any():
                    total[full] = np.add.reduceat(got, at[full])
                yield pa.RecordBatch.from_arrays([keys, words, pa.array(n), pa.array(total)], names=["key", "n_words", "n_features", "weight"])

    return gather


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    kind = packed.schema["keys"].dataType.elementType.simpleString()
    return packed.mapInArrow(_gathered(gain), f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel_key(key: str, seed: int):
    """floor of -1000 * ln(-ln(u)), u being uniform by the first 32 bits of sha256(`seed:key`) (native)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    shortest: int = 1,
    longest: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document, `rank` null where it isn't drawn.

    Of the documents with `least_words` words or more, `percent` in a hundred are drawn, rounded down.
    """
    packed = stored(streams(docs, key, text, shortest, longest, buckets), "resample-streams")
    wanted = streams(target.select(F.lit(0).alias("key"), target_text), "key", target_text, shortest, longest, buckets)
    gain = gains(counts(packed, buckets), counts(wanted, buckets))
    told = weights(packed, gain).withColumn("score", F.col("weight") + gumbel_key("key", seed))
    scored = stored(told, "resample-scores")
    discard(packed)
    long = F.col("n_words") >= least_words
    drawn = scored.where(long).count() * percent // 100
    ordered = ranked(scored.where(long), [F.desc("score"), F.asc("key"), F.rand(seed)], "rank")
    ordered = ordered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ordered.unionByName(scored.where(~long).withColumn("rank", F.lit(None).cast("bigint")))


__all__ = ["bucket_runs", "counts", "gains", "gumbel_key", "resample", "run_lengths", "streams", "weights"]
