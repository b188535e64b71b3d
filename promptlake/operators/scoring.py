"""Lexical and dense scoring, and their fusion."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlake.functions.patterns import text_of
from promptlake.functions.text import RUNS, tokens_ascii
from promptlake.functions.vectors import usable
from promptlake.session import ship_package

K1, B = 1.5, 0.75
RRF = 60


#: Terms of chunks (each chunk's counted) that may be sent to every task as an index, some 40 bytes each.
MAX_INDEX = 2_000_000
#: Rows that every query must be given whatever their rank.
MAX_MANDATORY = 1000


def bm25(
    queries: DataFrame, chunks: DataFrame, words=tokens_ascii, query_key: str = "query_id", chunk_key: str = "chunk_id", text: str = "text", max_index: int = MAX_INDEX, least: float = 0.0
) -> DataFrame:
    """(query, chunk, score) of every pair that shares a term and scores above `least`; a term repeated in the query counts again.

    Chunks of up to `max_index` terms (counted first) are sent to the tasks as an
    inverted index and scored where the query's text is, and pairs at `least` or below are never rows (rows of one query id
    are summed first, if any id is repeated). Beyond, terms meet by an
    equi-join, repeated ones summed before they are shuffled. Pairs without a common
    term (score 0) are made in neither way.
    """
    ship_package(queries.sparkSession)
    told = chunks.select(F.col(chunk_key), words(F.col(text)).alias("words"))
    terms = told.select(chunk_key, F.size("words").alias("length"), F.explode("words").alias("term"))
    tf = terms.groupBy(chunk_key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    corpus = told.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("average"))
    # one row of totals; its cross join adds two columns
    scored = tf.join(df, "term").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.when(F.col("average") > 0, F.col("average")).otherwise(1.0)))
    scored = scored.select(chunk_key, "term", weight.alias("weight"))
    if tf.limit(max_index + 1).count() <= max_index:
        return _by_index(queries, scored.toArrow(), words, text, query_key, chunk_key, scored.schema[chunk_key].dataType.simpleString(), least)
    asked = queries.select(F.col(query_key), F.explode(words(F.col(text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    return asked.join(scored, "term").groupBy(query_key, chunk_key).agg(F.sum(F.col("qtf") * F.col("weight")).alias("score")).where(F.col("score") > least)


def _by_index(queries: DataFrame, scored: pa.Table, words, text: str, query_key: str, chunk_key: str, kind: str, least: float) -> DataFrame:
    """bm25 with the weights of (chunk, term) sent to every task.

    Words that Python's re can find go to the tasks as the text they stand in, others as arrays.
    """
    keys = scored[chunk_key].combine_chunks().dictionary_encode()
    at, weight, of = keys.indices.to_numpy(), scored["weight"].to_numpy(), scored["term"].combine_chunks().dictionary_encode()
    order = np.argsort(of.indices.to_numpy(), kind="stable")
    cuts = np.searchsorted(of.indices.to_numpy()[order], np.arange(len(of.dictionary) + 1))
    place = {t: i for i, t in enumerate(of.dictionary.to_pylist())}
    sent = queries.sparkSession.sparkContext.broadcast((keys.dictionary, place, cuts, at[order], weight[order]))
    repeated = not queries.groupBy(query_key).count().where("count > 1").isEmpty()
    below = 0.0 if repeated else least
    run = RUNS.get(words)
    asked = words(F.col(text)) if run is None else F.lower(text_of(F.col(text)))

    @F.arrow_udf(f"array<struct<chunk: {kind}, score: double>>")
    def score(rows: pa.Array) -> pa.Array:
        chunks, place, cuts, at, weight = sent.value
        counts, places, scores = [0], [np.zeros(0, np.int64)], [np.zeros(0)]
        for row in rows:
            told = row.as_py() or ()
            known = [(place[t], n) for t, n in Counter(told if run is None or not told else run.findall(told)).items() if t in place]
            term, n = np.array(known, np.int64).reshape(-1, 2).T
            size = cuts[term + 1] - cuts[term]
            # the terms' stretches of the index, one after the other: bincount adds them in this order
            where = np.arange(size.sum()) + np.repeat(cuts[term] - np.cumsum(size) + size, size)
            total = np.bincount(at[where], np.repeat(n, size) * weight[where], len(chunks))
            some = np.flatnonzero(total > below)
            counts.append(len(some))
            places.append(some)
            scores.append(total[some])
        told = pa.StructArray.from_arrays([chunks.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], ["chunk", "score"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), told)

    each = queries.select(query_key, F.explode(score(asked)).alias("s")).select(query_key, F.col("s.chunk").alias(chunk_key), F.col("s.score").alias("score"))
    return each.groupBy(query_key, chunk_key).agg(F.sum("score").alias("score")).where(F.col("score") > least) if repeated else each


def similar_chunks(queries: DataFrame, chunks: DataFrame, threshold: float = 0.3, **keys) -> DataFrame:
    """Per query: chunks over the threshold and the best score, at most 1; queries without any are kept."""
    query_key = keys.get("query_key", "query_id")
    over = bm25(queries, chunks, least=threshold, **keys)
    best = over.groupBy(query_key).agg(F.count("*").alias("n_chunks"), F.least(F.max("score"), F.lit(1.0)).alias("score"))
    joined = queries.select(query_key).join(best, query_key, "left")
    return joined.select(query_key, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _best(asked: np.ndarray, told: np.ndarray, k: int, minimum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of told, cosine) of each asked row's k best; ties by row of told.

    Products are added one dimension after the other, as `cosine` does, so equal vectors score alike in any block.
    """

    def products(a, b):
        total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        for i in range(a.shape[-1]):
            total += a[..., i] * b[..., i]
        return total

    size = np.sqrt(products(asked, asked))[:, None] * np.sqrt(products(told, told))[None, :]
    score = np.where(size > 0, products(asked[:, None], told[None]) / np.where(size > 0, size, 1), 0.0)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(score, order, 1)
    row, at = np.nonzero(best >= minimum)
    return row, order[row, at], best[row, at]


def dense_top_blocks(queries: DataFrame, candidates: DataFrame, k: int = 5, minimum: float = 0.45, block: int = 512, query_key: str = "query_id", key: str = "id", vector: str = "vector") -> DataFrame:
    """(query, candidate, dense_score, dense_rank) of each query's k best cosines, for queries and candidates of any number whose vectors have one length and no nulls.

    Both are packed into blocks of about `block` rows. Every pair of blocks is one row; a query's best of each
    block meet in the last ranking, so pairs of rows are never rows of Spark.
    """

    ship_package(queries.sparkSession)

    def packed(df, name, of):
        n = max(1, -(-df.count() // block))
        told = df.select(F.col(of).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(of), F.lit(n)).alias(f"{name}_block"))
        rows = told.groupBy(f"{name}_block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
        return n, rows.select(f"{name}_block", F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vectors"))

    _, asked = packed(queries, "q", query_key)
    n, told = packed(candidates, "c", key)

    @F.arrow_udf("array<struct<q int, c int, score double>>")
    def best(q: pa.Array, c: pa.Array) -> pa.Array:
        matrix = lambda rows: np.array(rows.as_py(), np.float64)
        found = []
        for a, b in zip(q, c, strict=True):
            found.append([{"q": int(i), "c": int(j), "score": float(s)} for i, j, s in zip(*_best(matrix(a), matrix(b), k, minimum), strict=True)])
        return pa.array(found, pa.list_(pa.struct([("q", pa.int32()), ("c", pa.int32()), ("score", pa.float64())])))

    pairs = asked.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).join(told, "c_block")
    scored = pairs.select("q_ids", "c_ids", F.explode(best(F.col("q_vectors"), F.col("c_vectors"))).alias("s")).select(
        F.get("q_ids", F.col("s.q")).alias(query_key), F.get("c_ids", F.col("s.c")).alias(key), F.col("s.score").alias("dense_score")
    )
    order = Window.partitionBy(query_key).orderBy(F.desc("dense_score"), key)
    return scored.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k)


def lexical_ranks(scores: DataFrame, minimum: float = 0.0, query_key: str = "query_id", key: str = "id") -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    kept = scores.where(F.col("score") > minimum)
    return kept.select(query_key, key, F.col("score").alias("lexical_score"), F.row_number().over(order).alias("lexical_rank"))


def fused(dense: DataFrame, lexical: DataFrame, k: int = 5, constant: int = RRF, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion, the k best. Ties: dense rank (missing last), lexical rank, key."""
    both = dense.join(lexical, [query_key, key], "full")
    part = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part("dense_rank") + part("lexical_rank"))
    order = Window.partitionBy(query_key).orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), key)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query_key, key, "rank", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), "rrf_score")


def with_mandatory(selected: DataFrame, queries: DataFrame, mandatory: DataFrame, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Rows that must be judged whatever their rank, appended with zero scores after the selected ones.

    mandatory is the policy's list of blocking concepts, needed by each query; more than MAX_MANDATORY are refused.
    """
    if mandatory.select(key).distinct().limit(MAX_MANDATORY + 1).count() > MAX_MANDATORY:
        raise ValueError("more mandatory rows than every query can be given")
    every = queries.select(query_key).distinct().crossJoin(mandatory.select(key).distinct())
    missing = every.join(selected.select(query_key, key), [query_key, key], "left_anti")
    zero = F.lit(0.0)
    added = missing.select(query_key, key, F.lit(None).cast("int").alias("rank"), zero.alias("dense_score"), zero.alias("lexical_score"), zero.alias("rrf_score"))
    return selected.unionByName(added)


def index_health(index: DataFrame, dim: int, current_hash: Column | None = None, vector: str = "vector") -> DataFrame:
    """One row: n, n_bad and healthy. One missing, stale or unusable vector makes the whole index unfit."""
    good = usable(F.col(vector), dim)
    if current_hash is not None:
        good = good & F.coalesce(F.col("text_hash") == current_hash, F.lit(False))
    told = index.agg(F.count("*").alias("n"), F.count_if(~good).alias("n_bad"))
    return told.withColumn("healthy", (F.col("n") > 0) & (F.col("n_bad") == 0))


def rebuilt_index(concepts: DataFrame, dim: int | None = None, vector: str = "vector") -> DataFrame:
    """Active concepts with `indexed`: whether their vector is there (and, with dim, usable). The table replaces the old index as a whole."""
    there = F.coalesce(F.size(vector) > 0, F.lit(False))
    return concepts.where(F.col("review_status") == "ACTIVE").withColumn("indexed", there if dim is None else there & usable(F.col(vector), dim))


def index_counts(rebuilt: DataFrame) -> DataFrame:
    return rebuilt.agg(F.count_if("indexed").alias("indexed"), F.count_if(~F.col("indexed")).alias("failed"))


def regenerated(index: DataFrame, concepts: DataFrame, key: str = "concept_key") -> DataFrame:
    """The index after some concepts changed: their old rows go first, active ones with a vector come back.

    index and concepts share the index's columns; concepts has review_status beside.
    """
    kept = index.join(concepts.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rebuilt_index(concepts).where("indexed").select(index.columns))
