"""Nearest neighbours by an inverted multi-index (operator 5).

Vectors are cut in two halves, each quantised with its own k-means codebook (fitted
on a bounded sample); a vector's cell is its pair of centroids. A query walks the
pairs by the sum of its two distances (here negative inner products, which add up
over the halves) with a heap, until the cells hold enough candidates, and these are
reranked by their exact inner products. How many are enough is measured: two bounded
samples of queries are searched exhaustively, and the larger of the two numbers of
rows with which the walk finds ``recall`` of their neighbours is used for all (on
vectors without structure that is a large share; on clustered ones a small one).
Finer codebooks lower the share, so there are as many centroids as leave an eighth
of a vector a cell, up to ``MAX_CENTROIDS`` a half.

Vectors meet queries in blocks of neighbouring grid rows of bounded size on both
sides; a crowded row is cut, so it is many tasks, none of them larger. A query is
sent to the blocks that it visits, once each, with the visited cells as bits; every
block keeps its best k per query before the results are merged.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part (one component is enough); a query
never finds its own row; ties go to the smaller id; fewer than k candidates are all
returned; a repeated id is a row of its own, as a query (with k neighbours of its own) and as a
neighbour, also of the other rows of its id; a null id takes no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlake.llm.base import stored

MAX_TRAIN = 20_000
MAX_CENTROIDS = 128
MAX_TRIALS = 64
#: Components of a block of vectors, and of one of queries, that meet in a task: the larger they are, the fewer copies of each are shuffled.
BLOCK_COMPONENTS = 1 << 20
#: Queries of a block that are scored at once.
SCORED = 256


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles."""
    v = F.col(vector).cast("array<double>")
    told = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    told = told.where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    width = told.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    told = told.where(F.size("v") == (width.d if width else 0))
    # two halves need two components; a zero beside changes no product
    return told.withColumn("v", F.concat("v", F.array(F.lit(0.0)))) if width and width.d == 1 else told


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from k different rows; an emptied centroid keeps its place."""
    rows = np.unique(x, axis=0)
    centroids = rows[np.random.default_rng(5).permutation(len(rows))[:k]]
    for _ in range(rounds):
        of = _nearest(x, centroids)
        count = np.bincount(of, minlength=len(centroids))
        sums = np.stack([np.bincount(of, x[:, j], len(centroids)) for j in range(x.shape[1])], 1)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


class Index:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.cut = first.shape[1]
        self.sizes = np.zeros((len(first), len(second)), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.cut], self.first), _nearest(x[:, self.cut :], self.second)

    def walk(self, q: np.ndarray):
        """Cells (row, column) by summed distance, nearest first."""
        a, b = -self.first @ q[: self.cut], -self.second @ q[self.cut :]
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[order_a].tolist(), b[order_b].tolist()
        rows, columns = order_a.tolist(), order_b.tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            _, i, j = heap[0]
            yield rows[i], columns[j]
            if j + 1 < len(b):
                heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def probe(self, q: np.ndarray, enough: int) -> np.ndarray:
        """Which cells the walk visits until `enough` candidates are reached."""
        width, left = len(self.second), enough
        sizes, visited = self.sizes.ravel().tolist(), []
        for row, column in self.walk(q):
            at = row * width + column
            if sizes[at]:
                visited.append(at)
                left -= sizes[at]
                if left <= 0:
                    break
        seen = np.zeros(self.sizes.size, bool)
        seen[visited] = True
        return seen.reshape(self.sizes.shape)

    def groups(self, size: int) -> list[tuple[int, int]]:
        """Runs (first, last + 1) of grid rows that hold about `size` vectors; a row of more is alone."""
        held = self.sizes.sum(1)
        out, start, total = [], 0, 0
        for i, n in enumerate(held.tolist()):
            if i > start and total + n > size:
                out.append((start, i))
                start, total = i, 0
            total += n
        return [*out, (start, len(held))]


def build(vectors: DataFrame, n_centroids: int | None = None, max_train: int = MAX_TRAIN) -> tuple[Index, DataFrame, int]:
    """The index, its table (at, id, v, row, column) with every vector, `at` telling rows apart, and their number."""
    n = vectors.count()
    sample = _matrix(vectors.orderBy(F.xxhash64("id")).limit(max_train).select("v").toArrow()["v"])
    k = n_centroids or max(2, min(MAX_CENTROIDS, int((8 * n) ** 0.5)))
    cut = sample.shape[1] // 2
    index = Index(codebook(sample[:, :cut], k), codebook(sample[:, cut:], k))
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("struct<row: int, column: int>")
    def place(v: pa.Array) -> pa.Array:
        row, column = sent.value.cells(_matrix(v))
        return pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.array(column, pa.int32())], ["row", "column"])

    table = stored(vectors.withColumn("cell", place("v")).select(F.monotonically_increasing_id().alias("at"), "id", "v", "cell.row", "cell.column"), "ann-index")
    for r in table.groupBy("row", "column").count().collect():  # at most MAX_CENTROIDS squared
        index.sizes[r.row, r.column] = r["count"]
    return index, table, n


def exhaustive(table: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query, id, score, row, column): exact neighbours of a few queries, rows `at` of the table; best k of every batch merged."""
    rows, q = np.array([i for i, _ in queries], np.int64), np.stack([v for _, v in queries])

    def best(batches):
        for batch in batches:
            v, own = _matrix(batch.column("v")), batch.column("at").to_numpy()
            score = q @ v.T
            score[rows[:, None] == own[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(own)) - 1, axis=1)[:, :k] if len(own) else np.zeros((len(rows), 0), int)
            flat = top.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows, top.shape[1])), batch.column("id").take(pa.array(flat)), pa.array(np.take_along_axis(score, top, 1).ravel()), batch.column("row").take(pa.array(flat)), batch.column("column").take(pa.array(flat))],
                ["query", "id", "score", "row", "column"],
            )

    found = table.mapInArrow(best, "query long, id long, score double, row int, column int").where("score > double('-inf')")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def enough_candidates(index: Index, table: DataFrame, asked, k: int, recall: float, trials: int) -> int:
    """The number of candidates with which either of two samples of queries finds this share of its true neighbours."""
    sample = table.where(asked).orderBy(F.xxhash64("id"), "id").limit(2 * trials).toArrow()
    queries = list(zip(sample["at"].to_pylist(), _matrix(sample["v"]), strict=True))
    if not queries:
        return k + 1
    truth: dict[int, list[tuple[int, int]]] = {}
    for r in exhaustive(table, queries, k).collect():  # trials * k rows
        truth.setdefault(r.query, []).append((r.row, r.column))
    needed: tuple[list[int], list[int]] = ([], [])
    for half, (i, q) in enumerate(queries):
        seen, at, wanted = 0, {}, set(truth.get(i, []))
        for cell in index.walk(q):
            seen += int(index.sizes[cell])
            if cell in wanted:
                at[cell] = seen
                if len(at) == len(wanted):
                    break
        needed[half % 2].extend(at[c] for c in truth.get(i, []))
    enough = k + 1
    for counts in map(sorted, needed):
        if counts:
            enough = max(enough, counts[min(len(counts) - 1, int(np.ceil(recall * len(counts))))])
    return enough


def search(
    vectors: DataFrame, asked, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.93, n_centroids: int | None = None, trials: int = MAX_TRIALS
) -> DataFrame:
    """(query_id, rank, id, score) of the rows for which `asked` (a column of `id`) holds, against all rows."""
    table = usable(vectors, key, vector)
    if table.isEmpty():
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    index, table, n = build(table, n_centroids)
    enough = enough_candidates(index, table, asked, k, recall, trials)
    context = table.sparkSession.sparkContext
    sent = context.broadcast(index)

    # small tables make blocks for all cores
    block = min(max(SCORED, BLOCK_COMPONENTS // len(index.first[0]) // 2), max(SCORED, n // (4 * context.defaultParallelism)))
    groups = index.groups(block)
    edges = np.array([lo for lo, _ in groups])

    def probe(batches):
        for batch in batches:
            out: dict[str, list] = {"query": [], "query_id": [], "q": [], "part": [], "cells": []}
            for at, i, q in zip(batch.column("at").to_pylist(), batch.column("id").to_pylist(), _matrix(batch.column("v")), strict=True):
                seen = sent.value.probe(q, enough)
                for part, (lo, hi) in enumerate(groups):
                    if seen[lo:hi].any():
                        for name, value in zip(out, (at, i, q, part, np.packbits(seen[lo:hi]).tobytes()), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["query"], pa.int64()), pa.array(out["query_id"], pa.int64()), pa.array(out["q"], pa.list_(pa.float64())), pa.array(out["part"], pa.int32()), pa.array(out["cells"], pa.binary())],
                list(out),
            )

    probes = stored(table.where(asked).select("at", "id", "v").mapInArrow(probe, "query long, query_id long, q array<double>, part int, cells binary"), "ann-probes")
    # blocks of grid rows are at most MAX_CENTROIDS; each is cut by the numbers counted here
    per_part = {r.part: r["count"] for r in probes.groupBy("part").count().collect()}
    cuts = {p: (-(-int(index.sizes[slice(*groups[p])].sum()) // block), -(-int(m) // block)) for p, m in per_part.items()}
    if not cuts:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    by_part = F.create_map(*(F.lit(x) for p, c in cuts.items() for x in (p, c[0]))), F.create_map(*(F.lit(x) for p, c in cuts.items() for x in (p, c[1])))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v_cut, q_cut = (F.element_at(m, F.col("part")) for m in by_part)
    part_of = F.element_at(F.array(*(F.lit(int(np.searchsorted(edges, r, "right")) - 1) for r in range(len(index.first)))), F.col("row") + 1)
    left = table.withColumn("part", part_of).where(F.col("part").isin(list(cuts)))
    left = left.select("at", "id", "v", "row", "column", "part", F.pmod(F.xxhash64("at"), v_cut).cast("int").alias("vb"), numbers(q_cut).alias("qb"))
    right = probes.select("query", "query_id", "q", "cells", "part", F.pmod(F.xxhash64("query"), q_cut).cast("int").alias("qb"), numbers(v_cut).alias("vb"))
    grid = ["part", "vb", "qb"]

    def rerank(v: pa.Table, q: pa.Table) -> pa.Table:
        parts = [pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if len(v) and len(q):
            lo, hi = groups[v["part"][0].as_py()]
            # by grid row, then id and row number, which break ties
            v = v.sort_by([("row", "ascending"), ("id", "ascending"), ("at", "ascending")])
            held = [v[c].to_numpy() for c in ("at", "id", "row", "column")], _matrix(v["v"])
            parts += [_scored(*held, q.slice(start, SCORED), lo, hi, len(sent.value.second), k) for start in range(0, len(q), SCORED)]
        return pa.concat_tables(parts)

    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(rerank, "query long, query_id long, at long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _scored(columns: list[np.ndarray], x: np.ndarray, q: pa.Table, lo: int, hi: int, width: int, k: int) -> pa.Table:
    """The k best of a block of vectors for each of some queries, over the cells that it visits."""
    at, ids, row, column = columns
    asked, y = q["query"].to_numpy(), _matrix(q["q"])
    bits = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in q["cells"]])
    seen = np.unpackbits(bits, axis=1, count=(hi - lo) * width).reshape(len(y), hi - lo, width).astype(bool)
    score = np.full((len(y), len(ids)), -np.inf)
    for r in np.unique(row):  # rows of the grid that a query doesn't visit cost it nothing
        some = np.flatnonzero(seen[:, r - lo].any(1))
        of = slice(*np.searchsorted(row, [r, r + 1]))
        if len(some):
            score[some, of] = np.where(seen[some, r - lo][:, column[of]], y[some] @ x[of].T, -np.inf)
    score[asked[:, None] == at[None, :]] = -np.inf
    order = _best(score, ids, at, k)
    best = np.take_along_axis(score, order, 1)
    some = best > -np.inf
    who = np.broadcast_to(np.arange(len(y))[:, None], order.shape)[some]
    return pa.table({"query": pa.array(asked[who]), "query_id": pa.array(q["query_id"].to_numpy()[who]), "at": pa.array(at[order][some]), "id": pa.array(ids[order][some]), "score": pa.array(best[some])})


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best; among equal scores at the edge the smaller ids, then row numbers."""
    k = min(k, len(ids))
    by_id = np.lexsort((at, ids))
    score = score[:, by_id]
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above = score > edge
    room = k - above.sum(1, keepdims=True)
    tied = score == edge
    kept = above | (tied & (np.cumsum(tied, axis=1) <= room))
    return by_id[np.nonzero(kept)[1].reshape(len(score), k)]
