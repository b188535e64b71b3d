"""Toxicity by non-negative positive-unlabelled learning (operator 1).

Confirmed toxic texts and unlabelled texts train a linear model over hashed words
and word beginnings (square roots of their rates per word of the text). The risk is

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

where the unlabelled texts are drawn from all training texts whatever their label,
so that they hold both classes in the share that the class prior says, and the
estimate of the clean class's risk can't fall below zero. Features whose means in
the two samples differ by less than ``SCREEN`` standard errors are left out, and the
bias is then moved to where the same risk with the zero-one loss is least, half way
between neighbouring scores, so that 0.5 is the decision's boundary; calling no text
toxic is one of the choices.

Training reads a bounded sample: at most ``max_positive`` toxic and
``max_unlabelled`` unlabelled training texts, those with the smallest hashes of their
ids; the prior is counted over all labelled training rows. Every text is scored,
whole, in one vectorised pass; long texts add up piece by piece.

Defined results: null, empty and wordless texts get the model's base score; rows
with null labels or ids don't train; repeated rows score alike. Without any toxic
training text, or without any feature that passes the screen, every score is the
prior, below 0.5, so nothing is called toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import WORD, chunks, fold, multipliers, slices, texts_of, utf8, words_of

BITS = 18
#: Word beginnings of so many bytes are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6, 8)
#: Rates are counted per hundred words.
PER = 100.0
MAX_POSITIVE = 1500
MAX_UNLABELLED = 4000
#: Standard errors between the samples' means that a feature needs, and texts that it occurs in (two for each toxic text, if that is less).
SCREEN = 3.0
#: From so many toxic texts on; fewer tell less apart, so their screen is lower by this power of their share.
SCREEN_FROM, SCREEN_POWER = 300, 0.1
MIN_TEXTS = 8
#: The class prior's range: learning from positive texts needs one above zero.
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.49

_LONGEST = 64
_M = multipliers(_LONGEST + 16, 1)
_SALT = _M[_LONGEST:]


def _features(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, owner) of each feature's occurrence, and the owner of each word."""
    low = fold(data)
    starts, ends = words_of(low, owner)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.flatnonzero(WORD[low])
    word = np.repeat(np.arange(len(starts)), ends - starts)
    place = at - starts[word]
    term = (low[at].astype(np.uint64) + np.uint64(1)) * _M[np.minimum(place, _LONGEST - 1)]
    total = np.cumsum(term)
    first = np.cumsum(ends - starts) - (ends - starts)
    head = total - (total[first] - term[first])[word]
    salt = np.full(_LONGEST, -1)
    salt[np.array(BEGINNINGS) - 1] = np.arange(len(BEGINNINGS))
    kind = salt[np.minimum(place, _LONGEST - 1)]
    begun = np.flatnonzero(kind >= 0)
    last = first + (ends - starts) - 1
    mixed = np.concatenate([(head[begun] + np.uint64(1)) * _SALT[kind[begun]], (head[last] + np.uint64(1)) * _SALT[-1]])
    mixed ^= mixed >> np.uint64(29)
    bins = (mixed * _SALT[-2]) >> np.uint64(64 - BITS)
    owners = owner[starts]
    return bins.astype(np.int64), np.concatenate([owners[word[begun]], owners]), owners


def _rates(texts: pa.Array, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, square root of rate), ordered by row and bin; only of kept bins, if those are given."""
    n = len(texts)
    keys, words = [np.zeros((2, 0), np.int64)], np.zeros(n)
    for data, owner in chunks(*utf8(texts)):
        bins, owners, of = _features(data, owner)
        words += np.bincount(of, minlength=n)
        if kept is not None:
            some = kept[bins]
            bins, owners = bins[some], owners[some]
        keys.append(np.stack(np.unique((owners << BITS) | bins, return_counts=True)))
    key, count = np.concatenate(keys, axis=1)
    key, at = np.unique(key, return_inverse=True)
    count = np.bincount(at, count, len(key))
    row = key >> BITS
    return row, key & ((1 << BITS) - 1), np.sqrt(count * PER / np.maximum(words, 1)[row])


Rows = list[tuple[np.ndarray, np.ndarray]]


def moments(rows: Rows, width: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance of each bin's value, and the number of rows that have it; gathered block by block."""
    total, squares, known = np.zeros((3, width))
    for at in range(0, len(rows), block):
        bins = np.concatenate([b for b, _ in rows[at : at + block]])
        values = np.concatenate([v for _, v in rows[at : at + block]]).astype(np.float64)
        total += np.bincount(bins, values, width)
        squares += np.bincount(bins, values**2, width)
        known += np.bincount(bins, minlength=width)
    mean = total / max(1, len(rows))
    return mean, squares / max(1, len(rows)) - mean**2, known


class Sparse:
    """Rows of (bins, values) in blocks, with the products that gradient steps need."""

    def __init__(self, rows: Rows, new: np.ndarray | None = None, scale: np.ndarray | None = None, width: int = 0, block: int = 256):
        """new: the number of each bin, below 0 for those left out; scale: what its values are multiplied by."""
        self.n, self.width, self.blocks = len(rows), width, []
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            bins, values = np.concatenate([b for b, _ in part]), np.concatenate([v for _, v in part])
            row = np.repeat(np.arange(len(part), dtype=np.int16), [len(b) for b, _ in part])
            if new is not None:
                some = new[bins] >= 0
                bins, values, row = bins[some], values[some] * scale[bins[some]], row[some]
                bins = new[bins]
            self.blocks.append((at, len(part), row, bins.astype(np.int32), values.astype(np.float32)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.bincount(row, w[bins] * values, n) for _, n, row, bins, values in self.blocks)])

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for at, n, row, bins, values in self.blocks:
            out += np.bincount(bins, g[at : at + n][row] * values, self.width)
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 500, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (accelerated full-batch steps)."""
    width = positive.width
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    v, largest = np.random.default_rng(1).normal(size=width), 1e-9
    for _ in range(8):  # the steepest curvature bounds the step
        v = unlabelled.back(unlabelled.dot(v / (np.linalg.norm(v) + 1e-12)) / unlabelled.n)
        largest = np.linalg.norm(v)
    rate = 1 / (0.375 * largest + decay + 0.25)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        zp, zu = positive.dot(ahead_w) + ahead_b, unlabelled.dot(ahead_w) + ahead_b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # the loss of z as toxic has the slope s - 1, as clean s
        gp, gu = -prior * sp / positive.n, su / unlabelled.n
        if clean >= 0:
            gp = gp + prior * (sp - 1) / positive.n
        else:  # step back from the overfit part
            gp, gu = -gp, -gu
        new_w = ahead_w - rate * (positive.back(gp) + unlabelled.back(gu) + decay * ahead_w)
        new_b = ahead_b - rate * (gp.sum() + gu.sum())
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, t = (t - 1) / faster, faster
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w, b


def boundary(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The score above which calling a text toxic has the least non-negative zero-one risk; infinite if calling none has.

    Of thresholds with the same risk the highest is taken, so that doubt leaves texts alone.
    """
    seen = np.unique(np.concatenate([zp, zu]))
    at = np.concatenate([[np.inf], (seen[:0:-1] + seen[-2::-1]) / 2])
    hit = 1 - np.searchsorted(np.sort(zp), at) / len(zp)
    called = 1 - np.searchsorted(np.sort(zu), at) / len(zu)
    return float(at[np.argmin(prior * (1 - hit) + np.maximum(0, called - prior * hit))])


def fit(positive: Rows, unlabelled: Rows, prior: float, width: int = 1 << BITS) -> dict:
    (mean_p, var_p, known_p), (mean_u, var_u, known_u) = moments(positive, width), moments(unlabelled, width)
    apart = np.abs(mean_p - mean_u) / np.sqrt(np.maximum(var_p, var_u) / len(positive) + var_u / len(unlabelled) + 1e-9)
    kept = (apart > SCREEN * min(1.0, len(positive) / SCREEN_FROM) ** SCREEN_POWER) & (known_p + known_u >= min(MIN_TEXTS, 2 * len(positive)))
    base = float(np.log(prior / (1 - prior)))
    if not kept.any():
        return {"weights": np.zeros(width, np.float32), "bias": base}
    new = np.where(kept, np.cumsum(kept) - 1, -1)
    scale = 1 / np.sqrt(np.sqrt(var_u + mean_u**2) + 0.02)
    few_p, few_u = (Sparse(x, new, scale, int(kept.sum()) + 1) for x in (positive, unlabelled))
    w, b = fit_nnpu(few_p, few_u, prior)
    zp, zu = few_p.dot(w) + b, few_u.dot(w) + b
    at = boundary(zp, zu, prior)
    # if none is to be called, the largest score seen falls to the prior's
    b = b - at if np.isfinite(at) else b - max(zp.max(), zu.max()) + base
    weights = np.zeros(width, np.float32)
    weights[kept] = (w[:-1] * scale[kept]).astype(np.float32)
    return {"weights": weights, "bias": b}


def train(docs: DataFrame, labels: DataFrame, learn, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, text: str = "text", key: str = "doc_id") -> dict:
    """The model, from rows where `learn` (a column of docs) holds."""
    told = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("toxic").alias("toxic"))
    ids = docs.where(learn).select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    rows = ids.join(told, "key", "left").select("key", (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"), F.col("toxic").isNotNull().alias("looked"))
    share = rows.where("looked").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = F.xxhash64("key"), F.col("key")
    toxic = texts_of(docs, rows.where("toxic").select("key").orderBy(*order).limit(max_positive), key, text)
    other = texts_of(docs, rows.select("key").orderBy(*order).limit(max_unlabelled), key, text)

    def sparse(batches):
        for batch in batches:
            row, bins, rates = _rates(batch.column("text"))
            edges = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), pa.ListArray.from_arrays(edges, pa.array(bins, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(rates, pa.float32()))],
                ["h", "bins", "rates"],
            )

    def gathered(sample: DataFrame) -> Rows:
        found = sample.select(F.xxhash64("key").alias("h"), "text").mapInArrow(sparse, "h bigint, bins array<int>, rates array<float>").toArrow()
        order = np.argsort(found["h"].to_numpy(), kind="stable").tolist()
        return [(found["bins"][i].values.to_numpy(), found["rates"][i].values.to_numpy()) for i in order]

    prior = min(MOST_PRIOR, max(LEAST_PRIOR, share or LEAST_PRIOR))
    positive, other = gathered(toxic), gathered(other)
    if not positive or not other:
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": float(np.log(prior / (1 - prior)))}
    model = fit(positive, other, prior)
    del positive, other
    pa.default_memory_pool().release_unused()
    return model


def score(df: DataFrame, model: dict, text: str = "text", as_column: str = "toxicity") -> DataFrame:
    """df with each text's probability of being toxic."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def f(texts: pa.Array) -> pa.Array:
        w, z = sent.value["weights"], [np.zeros(0)]
        for part in slices(texts):
            row, bins, rates = _rates(part, w != 0)
            z.append(sent.value["bias"] + np.bincount(row, w[bins] * rates, len(part)))
        return pa.array(_sigmoid(np.concatenate(z)))

    return df.withColumn(as_column, f(F.col(text)))
