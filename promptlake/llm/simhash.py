"""SimHash near-duplicates by pigeonhole blocks (operator 7).

Texts are lower-cased (A-Z), cut into words at ASCII blanks and into shingles; a
64-bit fingerprint has a bit set where over half of the shingle hashes have it.
Fingerprints at `distance` or fewer differing bits are linked; components of
linked documents are named by their smallest id.

Only distinct fingerprints are compared. With ``distance`` differing bits, five
blocks leave ``5 - distance`` blocks untouched, so the fingerprints are joined on
every choice of that many blocks and verified by Hamming distance. A block value
that more than ``dense`` fingerprints share (a large group of near copies) is not
joined with itself: there each fingerprint is sent to every fingerprint at half
the distance, which two of them share exactly if they link (distance 2 only
needs single flips, of bits outside the shared blocks). Both ways are exact, so
nothing is capped, and the second grows linearly with the group.

Defined results: null counts as an empty text; texts without words have
fingerprint zero and link like any others; repeated rows and ids are kept;
a null id never becomes a component's name unless a group has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import LOWER, apart, discard, stored
from promptlake.llm.components import connected

BITS = 64
BLOCKS = 5
SEED = 42
_LOWER = LOWER.tobytes()


def _fingerprint(text: str, size: int) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    blank, digest = b" ", xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), 0
    for at in range(0, max(1, len(words) - size + 1), 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        grams = zip(*(part[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
        hashes = np.fromiter((digest(blank.join(g), SEED) for g in grams), np.uint64)
        ones += _ones(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return ones


def fingerprint(text, size: int = 5):
    """The fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def f(texts: pa.Array) -> pa.Array:
        marks = np.fromiter((_fingerprint(t.as_py() or "", size) for t in texts), np.uint64, len(texts))
        return pa.array(marks.view(np.int64))

    return f(text)


def mark_of(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed number, of a text whose shingles have these hashes."""
    ones = sum((_ones(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(BITS, np.int64))
    return _signed(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def hexadecimal(mark):
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def _masks(distance: int) -> list[int]:
    """The choices of blocks, as bit masks, one of which close fingerprints share."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, BLOCKS - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(marks: DataFrame, distance: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b), a < b, that connect distinct fingerprints (column `mark`) as far as links reach.

    Sparse blocks give every linked pair; dense ones a star for each shared
    neighbour, which joins the same fingerprints into the same components. The blocks
    are stored; the caller may discard what is returned by `stored_at`.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = _masks(distance)
    keyed = marks.select(
        "mark", F.posexplode(F.array(*(F.col("mark").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks))).alias("choice", "key")
    )
    counted = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("mark").alias("one")).where("n > 1")
    keyed = stored(keyed.join(apart(counted.select("choice", "key", "n")), ["choice", "key"]), "simhash-blocks")
    sparse = keyed.where(F.col("n") <= dense).select("choice", "key", F.col("mark").alias("a"))
    pairs = (
        sparse.join(apart(sparse.withColumnRenamed("a", "b")), ["choice", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    flips = F.filter(
        F.array(*(F.lit(_signed(1 << b)).cast("long") for b in range(BITS))),
        lambda bit: F.element_at(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)), F.col("choice") + 1).bitwiseAND(bit) == 0,
    )
    near = (
        keyed.where(F.col("n") > dense)
        .withColumn("near", F.explode(F.concat(F.array("mark"), F.transform(flips, lambda bit: F.col("mark").bitwiseXOR(bit)))))
        .select("choice", "near", "mark")
    )
    if distance == 1:
        near = near.join(apart(marks.select(F.col("mark").alias("near"))), "near", "left_semi")
    centre = near.groupBy("choice", "near").agg(F.min("mark").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(apart(centre.select("choice", "near", "a")), ["choice", "near"]).select("a", F.col("mark").alias("b")).where("a < b")
    found = pairs.unionByName(stars).distinct()
    found.stored_at = keyed.stored_at
    return found


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, distance: int = 2, dense: int = 64
) -> DataFrame:
    """(key, mark, component_id) for every row of docs."""
    marked = stored(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("mark")), "simhash-marks")
    groups = marked.groupBy("mark").agg(F.min("key").alias("least"))
    edges = links(groups.select("mark"), distance, dense)
    reach = connected(edges, "simhash")
    discard(edges)
    # a component of fingerprints is named by the smallest id below any of them
    member = groups.join(apart(reach.select(F.col("node").alias("mark"), "root")), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = member.join(apart(named), "root").select("mark", "component_id")
    return marked.join(apart(labels), "mark", "left").select(F.col("key").alias(key), "mark", "component_id")


__all__ = ["fingerprint", "hexadecimal", "links", "near_duplicates"]
