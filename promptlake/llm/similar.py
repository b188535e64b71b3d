"""Near copies by SimHash and exact Jaccard similarity of word shingles; MinHash bands find what SimHash leaves apart.

Words and shingles are those of SimHash (A-Z lower-cased, cut at ASCII blanks).
Two texts are linked if their sets of shingles (as 64-bit hashes) are similar to
`least` or more. Candidates are texts whose fingerprints reach one another by links
of at most ``DISTANCE`` bits (pigeonhole blocks, as in operator 7), and texts that
share one of ``BANDS`` bands of ``ROWS`` minima: at similarity 0.8 the bands miss a
pair with a chance of 0.04 %, above it with less. Every candidate is verified before it links.

Only distinct texts are compared. Each bucket's texts are first compared with a
few leaders. What these leave open (texts of one bucket in different components) is
compared pair by pair in buckets of up to `dense` texts. The texts of larger ones,
which share a passage or nearly are copies, meet by their rarest shingles instead:
in any order of shingles, two texts of n and m of them at similarity s first agree
at places that leave s / (1 + s) (n + m) shingles to come in both, so ordering by
rarity is exact, while what makes a bucket large (a common passage) comes last.
Shingles that the same texts hold count as one. No bucket is capped. Tables that
grow with the texts meet by shuffles only (``apart``), so the driver holds none of them.

Defined results: null counts as an empty text; texts without words are one text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm import simhash
from promptlake.llm.base import LOWER, apart, discard, multipliers, stored
from promptlake.llm.components import connected

BANDS, ROWS = 20, 5
DISTANCE = 2
SEED = 42
_LOWER = LOWER.tobytes()
_A, _B = multipliers(BANDS * ROWS, 21), multipliers(BANDS * ROWS, 22)
_MIX, _BAND = multipliers(ROWS, 23), multipliers(BANDS, 24)
#: Hashed bins in which shingles' rarity is counted.
BIN_BITS = 16
BINS = 1 << BIN_BITS
#: Leaders of a bucket: its first texts in as many orders.
_LEADERS = 4


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; fewer words than a shingle has are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """The different ones, sorted."""
    return np.unique(_hashes(words, size))


def _bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048, None] ^ _B) * _A).min(0), out=least)
    mixed = ((least ^ (least >> np.uint64(31))).reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * _BAND + _BAND).view(np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest()


def digest(text):
    """A text column's words as a 128-bit digest: equal for texts that differ only in blanks and A-Z."""

    @F.arrow_udf("string")
    def f(texts: pa.Array) -> pa.Array:
        return pa.array([_digest(_words(t.as_py())) for t in texts], pa.string())

    return f(text)


def _sketch(text, size: int):
    """Digest, number of different shingles, SimHash fingerprint, and band keys (none of the last two without words)."""

    @F.arrow_udf("struct<digest string, size bigint, mark bigint, bands array<bigint>>")
    def f(texts: pa.Array) -> pa.Array:
        digests, sizes, marks, bands = [], [], [], []
        for t in texts:
            words = _words(t.as_py())
            every = _hashes(words, size)
            hashes = np.unique(every)
            digests.append(_digest(words))
            sizes.append(len(hashes))
            marks.append(simhash.mark_of(every) if len(every) else None)
            bands.append(_bands(hashes) if len(hashes) else [])
        columns = [pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["digest", "size", "mark", "bands"])

    return f(text)


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _similar(a, b, size: int, least: float):
    """Whether two text columns have a Jaccard similarity of `least` or more."""

    @F.arrow_udf("boolean")
    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        shingles = lambda t: _shingles(_words(t), size)
        known = lru_cache(64)(shingles)
        of = lambda t: known(t) if len(t) < 1 << 16 else shingles(t)
        told = []
        for x, y in zip(a, b, strict=True):
            x, y = of(x.as_py()), of(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            told.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pa.array(told, pa.bool_())

    return f(a, b)


def _close(a: str, b: str, least: float):
    """Sizes that allow for the similarity."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def components(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, dense: int = 64) -> DataFrame:
    """(digest, root) of every distinct text that is a near copy of another; root is the component's smallest digest."""
    sketched = stored(docs.select(_sketch(F.col(text), shingle).alias("s")), "similar-sketches")
    texts = sketched.groupBy("s.digest").agg(F.first("s.size").alias("size"), F.first("s.mark").alias("mark"), F.first("s.bands").alias("bands"))
    links = simhash.links(sketched.select("s.mark").where("mark IS NOT NULL").distinct(), DISTANCE)
    groups = connected(links, "similar-marks").select(F.col("node").alias("mark"), F.col("root").alias("group"))
    discard(links)
    # a component of fingerprints is a bucket like those of the bands
    group = F.xxhash64(F.lit("simhash"), F.coalesce("group", "mark"))
    buckets = F.when(F.isnull("mark"), F.array().cast("array<bigint>")).otherwise(F.concat("bands", F.array(group)))
    keyed = texts.join(apart(groups), "mark", "left").select("digest", "size", F.explode(buckets).alias("bucket"))
    first = [F.min(F.struct(F.xxhash64("digest", F.lit(i)).alias("x"), "digest", "size")).alias(f"l{i}") for i in range(_LEADERS)]
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n"), *first).where("n > 1")
    leaders = F.array_distinct(F.array(*(F.struct(f"l{i}.digest", f"l{i}.size") for i in range(_LEADERS)))).alias("leaders")
    keyed = stored(keyed.join(apart(shared.select("bucket", "n", leaders)), "bucket"), "similar-buckets")

    candidates = keyed.select("digest", "size").distinct()
    own = docs.select(digest(F.col(text)).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    own = own.join(apart(candidates), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    own = stored(own, "similar-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (own.select(F.col("digest").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
        told = pairs.join(apart(a), "a").join(apart(b), "b")
        return stored(told.where(_similar(F.col("a_text"), F.col("b_text"), shingle, least)).select("a", "b"), name)

    led = keyed.select("digest", "size", F.explode("leaders").alias("leader")).where((F.col("digest") != F.col("leader.digest")) & _close("size", "leader.size", least))
    led = stored(led.select(F.least("digest", "leader.digest").alias("a"), F.greatest("digest", "leader.digest").alias("b")).distinct(), "similar-led")
    edges = verified(led, "similar-first")

    # what the leaders have not joined: buckets whose texts are in several components
    reach = connected(edges, "similar")
    told = keyed.drop("leaders").join(apart(reach.withColumnRenamed("node", "digest")), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    told = stored(told, "similar-told")
    small = _open_pairs(told.where(F.col("n") <= dense).select(F.col("bucket").alias("key"), "digest", "size", "root", F.lit(0).alias("at")), least, dense)
    crowded = _mixed(told.where(F.col("n") > dense).select(F.col("bucket").alias("key"), "digest", "size", "root"))
    crowded = crowded.select("digest", "size", "root").distinct()
    rare = stored(_rarest(crowded, own, shingle, least), "similar-rarest")
    large = _open_pairs(rare, least, dense)
    rest = small.unionByName(large).distinct().join(apart(led), ["a", "b"], "left_anti")
    rest = verified(rest, "similar-rest")
    stars = reach.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b")
    found = connected(stars.unionByName(rest), "similar").select(F.col("node").alias("digest"), "root")
    for df in (sketched, keyed, own, led, told, rare):
        discard(df)
    return found


def _mixed(keyed: DataFrame) -> DataFrame:
    """Rows of (key, digest, size, root) whose key has several roots."""
    several = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return keyed.join(apart(several.select("key")), "key", "left_semi")


def _open_pairs(keyed: DataFrame, least: float, dense: int) -> DataFrame:
    """(a, b), a < b: texts of one key (at their place `at`), of different roots, that are similar enough if all that follows is shared.

    Texts of the key's largest component meet only those outside it, never one
    another; rows of a key of many texts are dealt over several tasks.
    """
    counts = keyed.groupBy("key", "root").count()
    most = counts.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("n"), F.count("*").alias("roots"))
    keyed = keyed.join(apart(most.where("roots > 1").withColumn("salts", F.ceil(F.col("n") / dense).cast("int"))), "key")
    a = keyed.select("key", F.pmod(F.xxhash64("digest"), "salts").cast("int").alias("salt"), F.col("digest").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"), F.col("at").alias("a_at"))
    others = keyed.where("root <> most")
    b = others.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("digest").alias("b"), F.col("size").alias("b_size"), F.col("root").alias("b_root"), F.col("at").alias("b_at"))
    enough = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= (F.col("a_size") + F.col("b_size")) * F.lit(least / (1 + least)) - 1e-9
    pairs = a.join(apart(b), ["key", "salt"]).where((F.col("a_root") != F.col("b_root")) & _close("a_size", "b_size", least) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest(texts: DataFrame, own: DataFrame, shingle: int, least: float) -> DataFrame:
    """(key, digest, size, root, at): the rarest shingles of each text with their places, as many as similar texts must share one of.

    Rarity is counted in ``BINS`` hashed bins: any order that all texts follow is exact, so
    shingles that share a bin only cost time. Shingles that only one text has among its
    rarest are left out, and of those that the same texts have all but the first.
    """
    told = own.join(apart(texts.select("digest")), "digest", "left_semi")

    def count(batches):
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                seen += np.bincount(_bin(_shingles(_words(t.as_py()), shingle)), minlength=BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bin", "n"])

    bins = told.select("text").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counted = np.zeros(BINS, np.int64)
    counted[bins["bin"].to_numpy()] = bins["n"].to_numpy()
    sent = own.sparkSession.sparkContext.broadcast(counted)

    @F.arrow_udf("array<struct<at int, n bigint, h bigint>>")
    def first_ones(column: pa.Array) -> pa.Array:
        found = []
        for t in column:
            h = _shingles(_words(t.as_py()), shingle)
            n = sent.value[_bin(h)]
            order = np.lexsort((h.view(np.int64), n))[: len(h) - int(np.ceil(len(h) * least - 1e-9)) + 1]
            found.append([{"at": i, "n": int(n[j]), "h": int(h.view(np.int64)[j])} for i, j in enumerate(order.tolist())])
        return pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64()), ("h", pa.int64())])))

    each = stored(told.select("digest", F.explode(first_ones("text")).alias("x")).select("digest", "x.*"), "similar-rare")
    mark = F.xxhash64("digest")
    holders = each.groupBy("n", "h").agg(F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count("*").alias("holders"))
    kept = holders.where("holders > 1").groupBy("sum", "lo", "hi", "holders").agg(F.min(F.struct("n", "h")).alias("first")).select("first.h")
    return each.join(apart(kept), "h", "left_semi").join(apart(texts), "digest").select(F.col("h").alias("key"), "digest", "size", "root", "at")


def near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, as_column: str = "copy_of") -> DataFrame:
    """docs with the name (a digest) of each row's group of copies and near copies."""
    found = components(docs, text, shingle, least).select(F.col("digest").alias("digest__"), F.col("root").alias("root__"))
    told = docs.withColumn("digest__", digest(F.col(text))).join(apart(found), "digest__", "left")
    return told.select(*docs.columns, F.coalesce("root__", "digest__").alias(as_column))


__all__ = ["components", "digest", "near_copies"]
