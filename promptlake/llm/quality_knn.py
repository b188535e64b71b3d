"""Quality by nearest-neighbour voting in a latent-semantic space (operator 10).

Each text becomes counts of terms of two kinds: its hashed words, and hashed triples
of character shapes (runs of letters collapsed) with how far its words repeat. Log
counts times inverse document frequency, each kind scaled to its weight, are
projected on the leading singular directions of the labelled texts. The labelled
vectors (at most ``max_labelled``, by smallest hash of id) are broadcast; every
text's cosines to all of them are computed in blocks and the labels of the nearest
``k`` vote with their similarity as weight.

Defined results: null and empty texts have no terms and get the labelled texts'
mean label, as does everything if nothing is labelled (then 0.5); repeated rows
score alike; null labels don't train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import chunks, fold, multipliers, texts_of, utf8, words_of

#: Terms below SHAPES are shapes and repetition, the rest words.
SHAPES, TERMS = 2048, 4096
#: Lengths of the two kinds' parts of a vector; 0 leaves a kind out.
SHAPE_WEIGHT, WORD_WEIGHT = 1.0, 0.5
DIMENSIONS = 48
NEIGHBOURS = 25
MAX_LABELLED = 4000
#: Terms 0-63 tell how words repeat, those up to SHAPES are shape triples.
_SPECIAL = 64
_WEIGHT = 200.0

_M = multipliers(8, 10)
#: Shapes: every sign by itself, small letters 1, capitals 2, digits 3, characters beyond ASCII as small letters.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3


def _add(total: np.ndarray, owner: np.ndarray, bins: np.ndarray) -> None:
    """Count (owner, bin) occurrences, owners in order, into the rows they are of."""
    if len(owner):
        lo, hi = int(owner[0]), int(owner[-1]) + 1
        total[lo:hi] += np.bincount((owner - lo) * TERMS + bins.astype(np.int64), minlength=(hi - lo) * TERMS).reshape(-1, TERMS)


def _counts(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    total = np.zeros((n, TERMS), np.float32)
    words, fresh, twice = np.zeros(n), np.zeros(n), np.zeros(n)
    for data, owner in chunks(*utf8(texts)):
        shape = _SHAPE[data]
        keep = np.concatenate([[True], (shape[1:] != shape[:-1]) | (shape[1:] > 3) | (owner[1:] != owner[:-1])])
        shape, of = shape[keep].astype(np.uint64), owner[keep]
        if len(shape) > 2:
            inside = np.flatnonzero(of[2:] == of[:-2])
            mixed = shape[inside] * _M[0] + shape[inside + 1] * _M[1] + shape[inside + 2] * _M[2]
            _add(total, of[inside], _SPECIAL + (mixed >> np.uint64(33)) % np.uint64(SHAPES - _SPECIAL))
        low = fold(data)
        starts, ends = words_of(low, owner)
        if len(starts):
            sums = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _M[3])
            power = np.concatenate([[np.uint64(0)], sums])
            place = (low.astype(np.uint64) + np.uint64(7)) ** np.uint64(2)
            second = np.concatenate([[np.uint64(0)], np.cumsum(place * _M[4])])
            lengths = (ends - starts).astype(np.uint64)
            mark = (power[ends] - power[starts]) * _M[5] + (second[ends] - second[starts]) + lengths * _M[6] + low[starts].astype(np.uint64) * _M[7] + low[ends - 1].astype(np.uint64) * _M[2]
            who = owner[starts]
            _add(total, who, SHAPES + ((mark * _M[1]) >> np.uint64(40)) % np.uint64(TERMS - SHAPES))
            words += np.bincount(who, minlength=n)
            keyed = np.stack([who.astype(np.uint64), mark])
            order = np.lexsort(keyed[::-1])
            different = np.concatenate([[True], (keyed[:, order][:, 1:] != keyed[:, order][:, :-1]).any(0)])
            fresh += np.bincount(who[order][different], minlength=n)
            again = (who[1:] == who[:-1]) & (mark[1:] == mark[:-1])
            twice += np.bincount(who[1:][again], minlength=n)
    some = np.flatnonzero(words)
    many = np.maximum(words[some], 1)
    # the share of different words, seen against what a text of this length has room for
    total[some, np.minimum(31, (fresh[some] / many * 32).astype(int))] = _WEIGHT
    total[some, 32 + np.minimum(31, np.ceil(twice[some] / many * 31).astype(int))] = _WEIGHT
    return total


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    for part, weight in ((v[:, :SHAPES], SHAPE_WEIGHT), (v[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return v


def _vectors(weighted: np.ndarray, directions: np.ndarray) -> np.ndarray:
    v = weighted @ directions
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _directions(x: np.ndarray, n: int = DIMENSIONS, more: int = 16, rounds: int = 5) -> np.ndarray:
    """The leading right singular directions of x, by subspace iteration."""
    q = np.random.default_rng(10).normal(size=(x.shape[1], n + more)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :n].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, learn, max_labelled: int = MAX_LABELLED, text: str = "text", key: str = "doc_id") -> dict:
    """Directions and labelled vectors, from rows where `learn` (a column of docs) holds."""
    told = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"))
    ids = docs.where(learn).select(F.col(key).alias("key")).distinct().join(told, "key")
    sample = texts_of(docs, ids.orderBy(F.xxhash64("key"), "key").limit(max_labelled), key, text)

    def counted(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                c = _counts(part.column("text"))
                row, term = np.nonzero(c)
                edges = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (c[row, term], pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("quality").cast(pa.float64()), *lists], ["quality", "terms", "counts"])

    found = sample.select("text", "quality").mapInArrow(counted, "quality double, terms array<int>, counts array<float>").toArrow()
    label = found["quality"].to_numpy()
    if not len(label):
        return {"label": label, "base": 0.5}
    counts = np.zeros((len(label), TERMS), np.float32)
    for row, terms, n in zip(counts, found["terms"], found["counts"], strict=True):
        row[terms.values.to_numpy()] = n.values.to_numpy()
    return fitted(counts, label)


def fitted(counts: np.ndarray, label: np.ndarray) -> dict:
    """The model of labelled texts' term counts."""
    idf = np.log((1 + len(label)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    weighted = _weighted(counts, idf)
    directions = _directions(weighted)
    vectors = _vectors(weighted, directions)
    if not np.isfinite(vectors).all():
        raise ArithmeticError("the labelled texts' vectors are not finite")
    return {"idf": idf, "directions": directions, "vectors": vectors, "label": label, "base": float(label.mean())}


def score(df: DataFrame, model: dict, text: str = "text", k: int = NEIGHBOURS, as_column: str = "quality") -> DataFrame:
    """df with each text's similarity-weighted mean label of its nearest labelled texts."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def f(texts: pa.Array) -> pa.Array:
        m, parts = sent.value, []
        near = min(k, len(m["label"]))
        if not near:
            return pa.array(np.full(len(texts), m["base"]))
        for at in range(0, len(texts), 512):
            counts = _counts(texts[at : at + 512])
            cosine = _vectors(_weighted(counts, m["idf"]), m["directions"]) @ m["vectors"].T
            best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosine, best, 1), 0).astype(np.float64) ** 2
            voted = (weight * m["label"][best]).sum(1) / np.maximum(weight.sum(1), 1e-12)
            parts.append(np.where((counts.sum(1) > 0) & (weight.sum(1) > 0), voted, m["base"]))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return df.withColumn(as_column, f(F.col(text)))
