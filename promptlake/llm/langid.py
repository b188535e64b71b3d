"""Language ID by Bayesian evidence fusion (operator 6).

log P(language | everything) adds up, for each row,

* the text's likelihood: multinomial over hashed letter triples, counted for
  every language over all labelled texts (each task counts, Spark adds up);
* the declared markup language, P(declared | language);
* the address suffix, P(suffix | language);
* the host's prior, smoothed towards its suffix's, itself towards the corpus's.

The last three come from grouped aggregation of the text posteriors over all
rows; a row's own share is taken out of its host's counts. Evidence that a row
lacks (null, or a table without that column) is left out. A background model of
evenly spread triples stands for every language not trained.

Defined results: texts without letters, null and empty texts are judged by the
other evidence alone, and are `und` where there is none; an empty table gives an
empty one. `accepted` is true if a trained language wins or there is no text evidence
against it; texts without any letter are not accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import WORD, chunks, fold, multipliers, stored, utf8

BINS = 4096
MAX_LANGUAGES = 256
#: A text's likelihood counts for at most so many independent triples: neighbours depend on one another.
EVIDENCE = 60.0
#: Strength of a parent's prior, in rows.
STRENGTH = 5.0
#: Prior of the background model.
UNKNOWN = 1e-3
UND = "und"
#: A table of sums up to this size is broadcast; a row counts for so many bytes beside its key and sums.
MAX_SENT_BYTES, ROW_BYTES = 16 << 20, 64

_M = multipliers(3, 6)
_LETTER = WORD.copy()
_LETTER[48:58] = False


def _triples(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, owner) of each byte triple with a letter in its middle; other signs count as blanks."""
    low = fold(data)
    letter = _LETTER[low]
    low = np.where(letter, low, np.uint8(32)).astype(np.uint64)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = letter[1:-1] & (owner[:-2] == owner[1:-1]) & (owner[1:-1] == owner[2:])
    at = np.flatnonzero(mid)
    mixed = low[at] * _M[0] + low[at + 1] * _M[1] + low[at + 2] * _M[2]
    return (mixed >> np.uint64(64 - 12)).astype(np.int64), owner[at + 1]


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a blank around every text, so that first and last letters count."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    view, at = memoryview(data), offsets.tolist()
    joined = b"  ".join([view[a:b] for a, b in zip(at, at[1:], strict=False)])
    return np.frombuffer(b" " + joined + b" " if n else b"", np.uint8), offsets + 2 * np.arange(n + 1)


def train(labelled: DataFrame, text: str = "text", language: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict:
    """{languages, log (languages x BINS)} from every labelled row; the model, which every task gets, is refused beyond max_languages."""
    named = labelled.select(F.col(text).alias("text"), F.col(language).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], np.int64)
            sums = np.zeros(len(names) * BINS, np.int64)
            for data, owner in chunks(*_padded(batch.column("text"))):
                bins, owners = _triples(data, owner)
                sums += np.bincount(of[owners] * BINS + bins, minlength=len(sums)) if len(bins) else 0
            for name, row in zip(names, sums.reshape(-1, BINS), strict=True):
                total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bin": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})

    counts = named.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    per = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).limit(max_languages + 1).collect()
    if len(per) > max_languages:
        raise ValueError("too many languages for a model that every task receives")
    per.sort(key=lambda r: r.lang)
    table = np.full((len(per), BINS), 0.5)
    for row, r in zip(table, per, strict=True):
        for x in r.bins:
            row[x.bin] += x.n
    return {"languages": [r.lang for r in per], "log": np.log(table / table.sum(1, keepdims=True))}


def likelihood(text, model: dict, spark):
    """array<double> of per-language log likelihoods, the background last; null where a text has no letters."""
    log = np.concatenate([model["log"], np.full((1, BINS), -np.log(BINS))]).T.copy()
    sent = spark.sparkContext.broadcast(log)

    @F.arrow_udf("array<double>")
    def f(texts: pa.Array) -> pa.Array:
        log, n = sent.value, len(texts)
        sums, seen = np.zeros((n, log.shape[1])), np.zeros(n)
        for data, owner in chunks(*_padded(texts)):
            bins, owners = _triples(data, owner)
            if len(bins):
                seen += np.bincount(owners, minlength=n)
                for k in range(log.shape[1]):
                    sums[:, k] += np.bincount(owners, log[bins, k], n)
        tempered = sums * (np.minimum(seen, EVIDENCE) / np.maximum(seen, 1))[:, None]
        offsets = np.concatenate([[0], np.cumsum(np.where(seen > 0, log.shape[1], 0))])
        values = pa.array(tempered[seen > 0].ravel())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(seen == 0))

    return f(text)


def _let(value, body):
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(array):
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _softmax(scores):
    shares = lambda e: _let(_total(e), lambda total: F.transform(e, lambda x: x / total))
    shifted = lambda s: _let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return _let(scores, lambda s: _let(shifted(s), shares))


def _added(*arrays):
    found = arrays[0]
    for other in arrays[1:]:
        found = F.zip_with(found, F.coalesce(other, F.transform(found, lambda x: F.lit(0.0))), lambda a, b: a + b)
    return found


def identify(
    df: DataFrame, model: dict, text: str = "text", host: str | None = None, suffix: str | None = None, declared: str | None = None, as_column: str = "language"
) -> DataFrame:
    """df with a struct column: lang, probability, by_text (the text's own choice), accepted."""
    languages = [*model["languages"], UND]
    n = len(languages)
    spark = df.sparkSession
    prior = F.array(*(F.lit(float(np.log(UNKNOWN if x == UND else (1 - UNKNOWN) / max(1, n - 1)))) for x in languages))
    # numbered names, so that no column of df is taken for one of those made here
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    seen = df.toDF(*names.values())
    seen = seen.withColumn("loglik__", likelihood(F.col(names[text]), model, spark))
    for name, column in (("host__", host), ("suffix__", suffix), ("declared__", declared)):
        seen = seen.withColumn(name, F.col(names[column]) if column else F.lit(None).cast("string"))
    seen = seen.withColumn("own__", F.when(F.col("loglik__").isNotNull(), _softmax(_added(F.col("loglik__"), prior))))

    given = ["host__", "suffix__", "declared__"]
    adds = [F.coalesce(F.sum(F.col("own__")[i]), F.lit(0.0)) for i in range(n)]
    # one pass over the texts: the other sums add up these
    grouped = stored(seen.where("own__ IS NOT NULL").groupBy(*given).agg(F.array(*adds).alias("own__")), "language-evidence")

    def sums(*keys):
        rows = grouped.where(" AND ".join(f"{k} IS NOT NULL" for k in keys) or "true")
        return rows.groupBy(*keys).agg(F.array(*adds).alias("sums__"))

    def looked_up(rows, key, name):
        """rows with the sums of their key: sent to every task if the table is small, else joined by a shuffle."""
        found = sums(key).withColumnRenamed("sums__", name)
        size = found.agg(F.sum(F.octet_length(key) + 8 * n + ROW_BYTES)).first()[0] or 0
        small = size <= MAX_SENT_BYTES
        return rows.join(F.broadcast(found) if small else found, key, "left")

    every = sums().first()
    corpus = np.array(every["sums__"] if every else [0.0] * n) + 1.0
    corpus_share = F.array(*(F.lit(float(x)) for x in corpus / corpus.sum()))
    corpus_count = F.array(*(F.lit(float(x)) for x in corpus))

    def smoothed(counts, parent):
        """(counts + STRENGTH * parent) / total, counts never below zero."""
        given = lambda n, size: F.zip_with(n, parent, lambda c, p: (c + STRENGTH * p) / size)
        return _let(counts, lambda n: _let(_total(n) + STRENGTH, lambda size: given(n, size)))

    if suffix:
        seen = looked_up(seen, "suffix__", "bysuffix__")
    else:
        seen = seen.withColumn("bysuffix__", F.lit(None).cast("array<double>"))
    suffix_share = F.when(F.col("bysuffix__").isNotNull(), smoothed(F.col("bysuffix__"), corpus_share)).otherwise(corpus_share)
    if host:
        seen = looked_up(seen, "host__", "byhost__")
        others = F.when(
            F.col("own__").isNotNull(), F.zip_with("byhost__", "own__", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        ).otherwise(F.col("byhost__"))
        host_share = F.when(F.col("byhost__").isNotNull(), smoothed(others, suffix_share)).otherwise(suffix_share)
    else:
        host_share = suffix_share
    if declared:
        seen = looked_up(seen, "declared__", "bydeclared__")
        # P(declared | language), up to a factor that all languages share
        declared_log = F.zip_with("bydeclared__", corpus_count, lambda c, t: F.log((c + 0.5) / (t + 1.0)))
    else:
        declared_log = F.lit(None).cast("array<double>")
    zero = F.array(*(F.lit(0.0) for _ in languages))
    host_log = F.transform(host_share, lambda p: F.log(F.greatest(p, F.lit(1e-6))))
    posterior = _softmax(_added(zero, F.col("loglik__"), host_log, declared_log))
    named = F.array(*(F.lit(x) for x in languages))
    best = lambda scores: F.element_at(named, F.array_position(scores, F.array_max(scores)).cast("int"))
    seen = seen.withColumn("posterior__", posterior)
    evidence = F.col("loglik__").isNotNull() | F.col("host__").isNotNull() | F.col("declared__").isNotNull() | F.col("suffix__").isNotNull()
    lang = F.when(evidence, best(F.col("posterior__"))).otherwise(F.lit(UND))
    result = F.struct(
        lang.alias("lang"),
        F.when(evidence, F.array_max("posterior__")).otherwise(F.lit(0.0)).alias("probability"),
        F.when(F.col("own__").isNotNull(), best(F.col("own__"))).otherwise(F.lit(UND)).alias("by_text"),
        (F.col("loglik__").isNotNull() & (lang != UND)).alias("accepted"),
    )
    return seen.select(*(F.col(n).alias(c) for c, n in names.items() if c != as_column), result.alias(as_column))
