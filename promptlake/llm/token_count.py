"""Token counts through a digest cache (operator 9).

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens) in a
shared folder. Texts are digested by Spark; digests without a count for this
tokenizer version are grouped (pre-aggregated, so copies shuffle once), one row of
each is encoded, and the new counts are appended. Counts then join back by digest.

A run that dies before its append leaves the cache as it was; one that repeats an
append only repeats equal rows, which readers merge. Two runs may append to one cache
at a time: each adds its own files, and what both encoded is there twice, alike.

Defined results: null counts as an empty text with no tokens; repeated rows are
counted one by one; normalising content only replaces null, since these
tokenizers tell every two different texts apart.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import hidden
from promptlake.llm.pretoken import pieces

SCHEMA = "content string, tokenizer string, n_tokens bigint"
MAX_MODEL_BYTES = 64 << 20
#: Bytes of pieces and their counts that a worker remembers, each entry's own upkeep included; longer pieces aren't kept.
MEMORY_BYTES, ENTRY_BYTES, LONGEST = 16 << 20, 160, 64


class Counter:
    """The library's tokenizer of one file, with the counts of pieces it has met."""

    #: The last one built, with its key: a worker keeps no other.
    last: tuple[str, Counter] | None = None

    def __init__(self, model: bytes, kind: str, memory: int = MEMORY_BYTES):
        self.kind, self.memory, self.used, self.known = kind, memory, 0, {}
        if kind == "sentencepiece":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            self.library = tokenizers.Tokenizer.from_buffer(model)
            self.library.no_truncation()
            self.library.no_padding()
            self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, key: str, model: bytes, kind: str) -> Counter:
        if cls.last is None or cls.last[0] != key:
            cls.last = None
            cls.last = key, cls(model, kind)
        return cls.last[1]

    def counts(self, texts: list[str]) -> list[int]:
        if self.kind == "sentencepiece":
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        if self.kind != "byte_level":
            return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._pieces(t) if not any(s in t for s in self.special) else len(self.library.encode(t, add_special_tokens=False).ids) for t in texts]

    def _pieces(self, text: str) -> int:
        parts, known = pieces(text), self.known
        if self.used > self.memory:
            known.clear()
            self.used = 0
        missing, long = list(set(parts).difference(known)), {}
        if missing:
            for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                if len(p) > LONGEST:
                    long[p] = len(e.ids)
                else:
                    known[p] = len(e.ids)
                    self.used += 4 * len(p) + ENTRY_BYTES
        return sum(long[p] if p in long else known[p] for p in parts) if long else sum(map(known.__getitem__, parts))


def read_model(path: str) -> tuple[bytes, str, str]:
    """(bytes, kind, digest) of a tokenizer file; the digest also names the library's version."""
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the tokenizer is larger than may be sent to every task")
    if path.endswith(".model"):
        from sentencepiece import __version__

        kind = "sentencepiece"
    else:
        from tokenizers import __version__

        before = (spec := json.loads(model)).get("pre_tokenizer") or {}
        # pieces of a plain byte-level vocabulary don't depend on what stands around them
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        kind = "byte_level" if plain and not spec.get("normalizer") else "tokenizers"
    return model, kind, hashlib.sha256(model + f"{kind} {__version__}".encode()).hexdigest()


def cached(spark, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) that the cache has for this tokenizer; a cache that doesn't exist yet is empty."""
    try:
        found = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, path: str, cache: str, text: str = "text") -> str:
    """Encode the distinct texts that the cache doesn't know, append their counts; returns the tokenizer's digest."""
    spark = docs.sparkSession
    model, kind, tokenizer = read_model(path)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(Counter.of(tokenizer, sent.value, kind).counts(texts.to_pylist()), pa.int64())

    told = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content", F.sha2("text", 256))
    fresh = told.join(cached(spark, cache, tokenizer), "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))
    fresh.select("content", F.lit(tokenizer).alias("tokenizer"), count("text").alias("n_tokens")).write.mode("append").parquet(cache)
    return tokenizer


def token_counts(docs: DataFrame, path: str, cache: str, text: str = "text", as_column: str = "n_tokens") -> DataFrame:
    """docs with each text's number of tokens, from the cache that this call completes."""
    tokenizer = fill(docs, path, cache, text)
    digest = hidden(docs, "content__")
    known = cached(docs.sparkSession, cache, tokenizer).select(F.col("content").alias(digest), F.col("n_tokens").alias(as_column))
    return docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(known, digest, "left").drop(digest)
