"""The stored vector index against exhaustive search."""

import os

import numpy as np
from pyspark.sql import functions as F

from promptlake.operators import scoring, vector_index
from promptlake.sources.batches import work_path

ROW = "id bigint, vector array<double>, text_hash string"


def clustered(n=3000, dim=16, centres=40, seed=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dim))
    return [(i, v.tolist(), f"h{i}") for i, v in enumerate(x)]


def test_few_cells_find_most(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, ROW)
    path = work_path(spark, "test-index")
    assert vector_index.write_index(df, path, 16, cells=40, text_hash="text_hash") == 40
    asked = df.where("id % 30 = 0").select(F.col("id").alias("query_id"), "vector")
    report = {}
    found = {(r.query_id, r.key) for r in vector_index.search_index(spark, asked, path, 16, k=10, probes=4, minimum=0.0, report=report).collect()}
    truth = {(r.query_id, r.id) for r in scoring.dense_top_blocks(asked, df, k=10, minimum=0.0).collect()}
    assert len(found & truth) / len(truth) >= 0.9
    few = vector_index.search_index(spark, asked.limit(1), path, 16, k=10, probes=4, minimum=0.0, report=report)
    assert few.count() == 10 and report == {"cells": 40, "read": 4}
    local = path.removeprefix("file://").removeprefix("file:")
    assert len([d for d in os.listdir(f"{local}/vectors") if d.startswith("cell=")]) == 40


def test_stale_and_deleted_vectors_are_not_found(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [1.0, 0.2], "c"), (4, [1.0, 0.3], None)], ROW)
    path = work_path(spark, "test-index")
    vector_index.write_index(df, path, 2, cells=2, text_hash="text_hash")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, vector array<double>")
    current = spark.createDataFrame([(1, "a"), (2, "changed"), (4, None)], "key bigint, text_hash string")
    found = vector_index.search_index(spark, asked, path, 2, k=5, probes=2, minimum=-1.0, current=current).orderBy("dense_rank").collect()
    assert [(r.key, r.dense_rank) for r in found] == [(1, 1), (4, 2)]


def test_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, None, "c"), (4, [0.0, 0.0], "d"), (5, [1.0], "e"), (6, [float("nan"), 1.0], "f"), (None, [0.5, 0.5], "g")]
    df = spark.createDataFrame(rows, ROW)
    path = work_path(spark, "test-index")
    vector_index.write_index(df, path, 2, cells=4)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, vector array<double>")
    found = vector_index.search_index(spark, asked, path, 2, k=5, probes=4, minimum=0.5).collect()
    assert sorted((r.query_id, r.key if r.key is not None else -1) for r in found) == [(1, -1), (1, 1), (1, 2)]
    assert vector_index.search_index(spark, asked.where("query_id > 1"), path, 2).count() == 0
    empty = work_path(spark, "test-index")
    vector_index.write_index(df.limit(0), empty, 2)
    assert vector_index.search_index(spark, asked, empty, 2).count() == 0
