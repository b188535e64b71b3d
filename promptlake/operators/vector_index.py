"""A stored index of vectors: partitioned by coarse cell, so that a search reads the folders of the cells it visits.

Cells are the centroids of a k-means over a bounded sample of directions; every vector lies in the
folder of its nearest one. A query visits its nearest cells; their vectors meet the
queries in blocks and are scored by exact cosine, so the cells decide only what is
compared. Vectors whose text has changed since (by hash), and deleted ones, are
skipped at search, by joins with what is current.

Defined results: vectors that `usable` refuses (missing, of another length, not finite, all zero) are in no folder and ask for
nothing; fewer than k answers are all returned; ties go to the smaller key; rows of one query key are one query with the best of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlake.functions.vectors import usable
from promptlake.operators.scoring import _best
from promptlake.session import ship_package

#: Vectors that the centroids are fitted on, rounds of the fit, and rows of a block.
SAMPLE, ROUNDS, BLOCK = 20_000, 12, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fitted(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centroids of directions: each vector is with the centroid of the largest product."""
    x = _unit(sample)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(1)
        sums = np.stack([np.bincount(of, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centres[full] = _unit(sums[full])
    return centres


def _nearest(centres: np.ndarray, n: int):
    """A column function: the n nearest cells of a vector."""

    @F.arrow_udf("array<int>")
    def each(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        order = np.argsort(-(_matrix(v) @ centres.T), axis=1, kind="stable")[:, :n]
        return pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return each


def write_index(vectors: DataFrame, path: str, dim: int, cells: int = 64, key: str = "id", vector: str = "vector", text_hash: str | None = None) -> int:
    """Write the index of (key, vector, text_hash) to path: `vectors` by cell, and `cells`. Gives the number of cells."""
    ship_package(vectors.sparkSession)
    kept = [F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), (F.col(text_hash) if text_hash else F.lit(None)).cast("string").alias("text_hash")]
    told = vectors.where(usable(F.col(vector), dim)).select(*kept)
    n, kind = told.count(), told.schema["key"].dataType.simpleString()
    share = min(1.0, SAMPLE / max(1, n))
    some = told.where(F.pmod(F.xxhash64("key", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(2 * SAMPLE).toArrow()["vector"]
    centres = fitted(_matrix(some), cells) if len(some) else np.zeros((1, dim))
    vectors.sparkSession.createDataFrame([(i, c.tolist(), kind) for i, c in enumerate(centres)], "cell int, centre array<double>, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    placed = told.withColumn("cell", _nearest(centres, 1)(F.col("vector"))[0])
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return len(centres)


def search_index(
    spark: SparkSession, queries: DataFrame, path: str, dim: int, k: int = 5, probes: int = 8, minimum: float = 0.45, query_key: str = "query_id", vector: str = "vector", current: DataFrame | None = None, report: dict | None = None
) -> DataFrame:
    """(query_key, key, dense_score, dense_rank): each query's k best cosines among the vectors of its `probes` nearest cells.

    current (key, text_hash), if given, lists what may be found: a vector that isn't there with its hash is stale or deleted.
    `report` gets how many cells there are and how many were read.
    """
    ship_package(spark)
    told = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many rows as cells
    centres = np.array([r.centre for r in told])
    asked = queries.where(usable(F.col(vector), dim)).select(F.col(query_key).alias("query"), F.col(vector).cast("array<double>").alias("q"))
    asked = asked.withColumn("cell", F.explode(_nearest(centres, probes)(F.col("q"))))
    counts = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    if report is not None:
        report |= {"cells": len(centres), "read": len(counts)}
    kind = told[0].kind
    stored = spark.read.schema(f"key {kind}, vector array<double>, text_hash string, cell int").parquet(f"{path}/vectors").where(F.col("cell").isin(list(counts)) if counts else F.lit(False))
    if current is not None:
        same = (F.col("v.key") == F.col("c.key")) & F.col("v.text_hash").eqNullSafe(F.col("c.text_hash"))
        stored = stored.alias("v").join(current.select("key", "text_hash").alias("c"), same, "left_semi")
    # a cell's queries and vectors are cut into blocks, so a crowded cell is many tasks
    sizes = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}
    cuts = {c: (-(-n // BLOCK), -(-counts[c] // BLOCK)) for c, n in sizes.items()}
    if not cuts:
        return spark.createDataFrame([], f"{query_key} {queries.schema[query_key].dataType.simpleString()}, key {kind}, dense_score double, dense_rank int")
    cut = lambda i: F.element_at(F.create_map(*(F.lit(x) for c, n in cuts.items() for x in (c, n[i]))), F.col("cell"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = stored.select("key", "vector", "cell", F.pmod(F.xxhash64("key", "vector"), cut(0)).cast("int").alias("vb"), numbers(cut(1)).alias("qb"))
    right = asked.where(F.col("cell").isin(list(cuts))).select("query", "q", "cell", F.pmod(F.xxhash64("query", "q"), cut(1)).cast("int").alias("qb"), numbers(cut(0)).alias("vb"))
    grid = ["cell", "vb", "qb"]
    schema = f"query {asked.schema['query'].dataType.simpleString()}, key {stored.schema['key'].dataType.simpleString()}, dense_score double"
    names = ["query", "key", "dense_score"]

    def rerank(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return pa.table({"query": q["query"].slice(0, 0), "key": v["key"].slice(0, 0), "dense_score": pa.array([], pa.float64())})
        v = v.sort_by("key")
        i, j, score = _best(_matrix(q["q"]), _matrix(v["vector"]), k, minimum)
        return pa.table([q["query"].take(pa.array(i)), v["key"].take(pa.array(j)), pa.array(score)], names=names)

    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(rerank, schema)
    found = found.groupBy("query", "key").agg(F.max("dense_score").alias("dense_score"))
    order = Window.partitionBy("query").orderBy(F.desc("dense_score"), "key")
    return found.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k).withColumnRenamed("query", query_key)


__all__ = ["fitted", "search_index", "write_index"]
