"""Ranked lexical search over a reordered, clustered index (operator 11).

Texts are cut into terms of digits, letters and characters beyond ASCII, A-Z
lower-cased. A query's terms score a document by saturated frequency and length in
whole numbers, so every path gives the same score. The steps:

* one scan keeps of every document its length and the frequencies of terms that queries hold;
* recursive graph bisection of a sample of documents (SAMPLE at most twice over, fitted as a
  model) makes a tree: documents on both sides of a node are swapped as long as
  that makes the terms' gaps cheaper; every document then goes down the tree by its terms'
  leanings, which puts like documents side by side;
* in that order documents are cut into shards of at most SHARD_DOCS documents and about SHARD_POSTINGS
  postings, each with its terms' postings and largest impacts. Ranges of the order are built by as many tasks, so a leaf
  with a third of all documents (copies of one) is many shards;
* a query's bound for a shard is what its terms' largest impacts add up to. Shards are
  visited from the largest bound down, in waves that grow GROWTH times. A query ends
  when its next bound is below its k-th score: no document left can enter, and
  equal scores, which the smaller id would decide, are still visited.

Queries are known beforehand, so the index leaves out terms that none of them asks for; lengths and
counts are of all terms. Queries travel to the tasks in sets of at most `max_terms` terms (counted
first), each with an index of its own.

Defined results: null texts and texts without terms are no documents and ask for nothing;
a term repeated in a query counts once; a null id sorts first among equal scores; rows that repeat an id, of documents or
queries, are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlake.llm.base import discard, stored, utf8
from promptlake.llm.resample import word_parts

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the queries (each query's counted) in one set.
MAX_TERMS = 500_000
#: Documents that the bisection is fitted on, twice that at most; what terms are hashed to there; depth of the tree; rounds of swaps at a node.
SAMPLE, HASHED, DEPTH, SWAPS = 8192, 8192, 6, 12
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 18
#: Shards of a query's first wave, and how much larger each next one is.
FIRST, GROWTH = 4, 8
#: Pairs of query and shard (some 16 bytes each) that may be sent to every task.
SENT_PAIRS = 4_000_000
#: Shards that may be named in a filter pushed to the index's files.
NAMED = 1000


def terms_of(text: str | None) -> set[bytes]:
    return {w for part in word_parts((text or "").encode("utf-8", "surrogatepass")) for w in part}


def _frequencies(sent):
    """Batches of (key, text) to (key, n, terms, tfs): the length, and how often each term of the vocabulary occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            lengths, ends, terms, tfs = [], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, found = 0, []
                for part in word_parts(data[a:b].tobytes()):
                    n += len(part)
                    ids = np.fromiter(map(number.get, part, repeat(-1)), np.int32, len(part))
                    found.append(ids[ids >= 0])
                own, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
                lengths.append(n)
                ends.append(ends[-1] + len(own))
                terms.append(own)
                tfs.append(counts)
            cuts = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    return read


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits of a term's gaps if `degree` of `size` documents hold it."""
    return degree * np.log2((size + 1) / (degree + 1))


class Bisection:
    """A tree of documents' halves: each node leans on hashed terms, and a document above the node's middle goes right."""

    def __init__(self, lean: np.ndarray, middle: np.ndarray):
        self.lean, self.middle = lean, middle

    @staticmethod
    def hashed(terms: np.ndarray) -> np.ndarray:
        return (terms.astype(np.int64) * 2654435761 % (1 << 32) >> 7) % HASHED

    @classmethod
    def fit(cls, docs: list[np.ndarray], depth: int = DEPTH) -> Bisection:
        """From a sample of documents, each the different terms it holds."""
        docs = [np.unique(cls.hashed(d)) for d in docs if len(d)]
        lean, middle = np.zeros((1 << depth, HASHED), np.float32), np.zeros(1 << depth)
        level = {1: np.arange(len(docs))}
        for _ in range(depth):
            below = {}
            for node, own in level.items():
                right = cls._halves([docs[i] for i in own])
                if right is None:
                    continue
                one, two = (np.bincount(np.concatenate([docs[i] for i in own[side]]), minlength=HASHED) for side in (right, ~right))
                lean[node] = np.log2((one + 1) / (right.sum() + 1)) - np.log2((two + 1) / ((~right).sum() + 1))
                said = np.array([lean[node][docs[i]].sum() for i in own])
                middle[node] = np.median(said)
                up = said > middle[node]
                below |= {2 * node: own[~up], 2 * node + 1: own[up]}
            level = below
        return cls(lean, middle)

    @staticmethod
    def _halves(docs: list[np.ndarray]) -> np.ndarray | None:
        """True for the half of the documents that go right: pairs are swapped while both moves together gain."""
        if len(docs) < 4:
            return None
        flat, starts = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
        owner = np.repeat(np.arange(len(docs)), np.diff(starts))
        # a first order by what the documents hold, so that like ones begin together
        right = np.zeros(len(docs), bool)
        right[np.argsort(np.add.reduceat(flat % 1021, starts[:-1]) / np.diff(starts), kind="stable")[len(docs) // 2 :]] = True
        for _ in range(SWAPS):
            one, two = (np.bincount(flat[side[owner]], minlength=HASHED).astype(float) for side in (right, ~right))
            n1, n2 = int(right.sum()), int((~right).sum())
            leave = _cost(one, n1) + _cost(two, n2) - _cost(np.maximum(one - 1, 0), n1) - _cost(two + 1, n2)
            enter = _cost(one, n1) + _cost(two, n2) - _cost(one + 1, n1) - _cost(np.maximum(two - 1, 0), n2)
            gain = np.add.reduceat(np.where(right[owner], leave[flat], enter[flat]), starts[:-1])
            out, into = (side[np.argsort(-gain[side], kind="stable")] for side in (np.flatnonzero(right), np.flatnonzero(~right)))
            n = min(len(out), len(into))
            worth = int((gain[out[:n]] + gain[into[:n]] > 1e-9).sum())
            if not worth:
                break
            right[out[:worth]], right[into[:worth]] = False, True
        return right

    def place(self, terms: np.ndarray) -> tuple[int, float]:
        """(leaf, leaning at the last node) of a document."""
        own, node, said = np.unique(self.hashed(terms)), 1, 0.0
        while node < len(self.middle):
            said = float(self.lean[node][own].sum())
            node = 2 * node + (said > self.middle[node])
        return node - len(self.middle), said


def _placed(sent):
    """Adds leaf and leaning."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            ends = np.append(batch.column(2).offsets.to_numpy()[:-1], batch.column(2).offsets[-1].as_py())
            terms = batch.column(2).values.to_numpy()
            spots = [tree.place(terms[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            told = [pa.array([s[0] for s in spots], pa.int32()), pa.array([s[1] for s in spots], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=["key", "n", "terms", "tfs", "leaf", "leaning"])

    return place


def impacts(n: list[int], tf: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; document i has counts[i] entries of tf."""
    m = np.repeat(np.array([50 + 50 * x * n_docs // n_terms for x in n], np.int64), counts)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _shards(n_docs: int, n_terms: int):
    """Documents in their new order to shards: keys (ascending, so places break ties), and per term its postings and largest impact."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        # the lists are joined as tables, so a slice's offsets start at 0 again
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows["key"], null_placement="at_start"))
        terms, tfs = (rows[c].combine_chunks() for c in ("terms", "tfs"))
        counts = pc.list_value_length(terms).to_numpy()
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        impact = impacts(rows["n"].to_pylist(), tf, counts, n_docs, n_terms)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], doc[order], impact[order].astype(np.int32)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        keys = rows["key"].combine_chunks()
        lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (term[starts], np.append(starts, len(term)), np.maximum.reduceat(impact, starts))]
        packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (doc, impact)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *lists, *packed], names=["keys", "terms", "starts", "tops", "docs", "impacts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            at = 0
            while at < len(batch):
                before = int(sizes[at - 1]) if at else 0
                upto = int(np.searchsorted(sizes, before + SHARD_POSTINGS - postings, "right"))
                upto = min(max(upto, at + (not held)), at + SHARD_DOCS - docs, len(batch))
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    docs, postings = docs + upto - at, postings + int(sizes[upto - 1]) - before
                if upto < len(batch):
                    yield shard(held)
                    held, docs, postings = [], 0, 0
                at = upto
        if held:
            yield shard(held)

    return build


class Queries:
    """A set of queries as numbers: query i has terms[starts[i]:starts[i + 1]] with their weights."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        self.starts = np.cumsum([0, *map(len, terms)])
        self.terms = np.concatenate(terms)
        self.weights = weight[self.terms]
        self.size = len(weight)


def _bounds(sent):
    """Shards' (shard, terms, tops) to (query, shard, bound) of every pair that shares a term."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        top = np.zeros(asked.size, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column(1)[i].values.to_numpy()
                top[own] = batch.column(2)[i].values.to_numpy()
                found = np.add.reduceat(top[asked.terms] * asked.weights, asked.starts[:-1])
                top[own] = 0
                some = np.flatnonzero(found)
                shard = pa.repeat(batch.column(0)[i], len(some))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), shard, pa.array(found[some])], names=["query", "shard", "bound"])

    return bound


def best_places(total: np.ndarray, least: int, k: int) -> np.ndarray:
    """The places of the k largest totals of `least` or more, equal ones by the smaller place."""
    some = np.flatnonzero(total >= least)
    if len(some) > k:
        edge = np.partition(total[some], len(some) - k)[len(some) - k]
        above = some[total[some] > edge]
        some = np.concatenate([above, some[total[some] == edge][: k - len(above)]])
    return some


def _visits(sent, k: int):
    """(keys, terms, starts, docs, impacts, asked) to (query, key, score): each visited shard's best for each of its queries."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        spot = np.full(queries.size, -1, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                keys, own, starts = (batch.column(c)[i].values for c in range(3))
                docs, impact = (np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in (3, 4))
                own, starts = own.to_numpy(), starts.to_numpy()
                spot[own] = np.arange(len(own))
                who, where, what = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in batch.column(5)[i].as_py():
                    a, b = queries.starts[x["query"] : x["query"] + 2]
                    at = spot[queries.terms[a:b]]
                    total = np.zeros(len(keys), np.int64)
                    for s, w in zip(at[at >= 0], queries.weights[a:b][at >= 0], strict=True):
                        part = slice(starts[s], starts[s + 1])
                        total[docs[part]] += w * impact[part].astype(np.int64)
                    some = best_places(total, max(1, x["least"]), k)
                    who += [x["query"]] * len(some)
                    where.append(some)
                    what.append(total[some])
                spot[own] = -1
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), keys.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(what))], names=["query", "key", "score"])

    return visit


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_set(docs: DataFrame, items: list, schema: str, k: int, report: list | None) -> DataFrame | None:
    """(item, rank, key, score) of one set of queries: rows of item and text."""
    spark = docs.sparkSession
    context = spark.sparkContext
    number: dict[bytes, int] = {}
    told = [(r.item, np.array([number.setdefault(t, len(number)) for t in sorted(terms_of(r.text))], np.int64)) for r in items]
    told = [x for x in told if len(x[1])]
    if not told:
        return None
    kind = docs.schema["key"].dataType.simpleString()
    row = f"key {kind}, n bigint, terms array<int>, tfs array<bigint>"
    read = stored(docs.mapInArrow(_frequencies(context.broadcast(number)), row), "lexical-terms")
    size = read.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    held = read.where(F.size("terms") > 0)
    df = np.zeros(len(number), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = context.broadcast(Queries([t for _, t in told], weight))

    chance = min(1.0, SAMPLE / max(1, size.docs))
    some = held.where(F.pmod(F.xxhash64("key", "n", "terms"), F.lit(1 << 30)) < int(chance * (1 << 30))).select("terms").limit(2 * SAMPLE)
    tree = context.broadcast(Bisection.fit([np.array(r.terms, np.int32) for r in some.toLocalIterator()]))
    placed = held.mapInArrow(_placed(tree), f"{row}, leaf int, leaning double")
    order = ["leaf", "leaning", F.rand(11)]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions("leaf", "leaning").select("key", "n", "terms", "tfs")
    schema_of = f"keys array<{kind}>, terms array<int>, starts array<int>, tops array<int>, docs binary, impacts binary"
    index = stored(ordered.mapInArrow(_shards(size.docs, size.terms), schema_of).withColumn("shard", F.monotonically_increasing_id()), "lexical-index")
    discard(read)

    bounds = index.select("shard", "terms", "tops").mapInArrow(_bounds(asked), "query int, shard bigint, bound bigint")
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "shard"))
    visits = stored(bounds.withColumn("turn", turn), "lexical-visits")
    best, done, wave = None, 0, FIRST
    while True:
        due = visits.where((F.col("turn") > done) & (F.col("turn") <= done + wave))
        if best is None:
            due = due.withColumn("least", F.lit(0).cast("bigint"))
        else:
            kth = best.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
            due = due.join(kth, "query", "left").where(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True))).withColumn("least", F.coalesce("least", F.lit(0)))
        due = due.groupBy("shard").agg(F.collect_list(F.struct("query", "least")).alias("asked"))
        due = stored(due, "lexical-due")
        shards = [r.shard for r in due.select("shard").limit(NAMED + 1).collect()]
        if not shards:
            discard(due)
            break
        pairs = due.agg(F.sum(F.size("asked"))).first()[0]
        if report is not None:
            report.append(pairs)
        wanted = index.where(F.col("shard").isin(shards)) if len(shards) <= NAMED else index
        met = wanted.join(F.broadcast(due) if pairs <= SENT_PAIRS else due, "shard").select("keys", "terms", "starts", "docs", "impacts", "asked")
        found = met.mapInArrow(_visits(asked, k), f"query int, key {kind}, score bigint")
        new = stored(_ranked(found if best is None else found.unionByName(best.drop("rank")), k), "lexical-best")
        for old in (due, best):
            if old is not None:
                discard(old)
        best, done, wave = new, done + wave, wave * GROWTH
    discard(visits)
    discard(index)
    if best is None:
        return None
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(told)], f"query int, item {schema}")
    return best.join(names, "query").select("item", F.col("rank").cast("int").alias("rank"), "key", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 50,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "item_id",
    query_text: str = "text",
    max_terms: int = MAX_TERMS,
    report: list | None = None,
) -> DataFrame:
    """(item, rank, key, score): each query's k best documents with a score above 0, equal scores by ascending key.

    `report` gets the number of visited pairs of query and shard of each wave.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_key).alias("item"), F.col(query_text).alias("text")).where("text IS NOT NULL")
    n_terms = asked.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    n_sets = max(1, -(-int(n_terms) // max_terms))
    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    parts = []
    for i in range(n_sets):
        items = (asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_sets)) == i) if n_sets > 1 else asked).collect()
        parts.append(_search_set(told, items, kind, k, report))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], f"item {kind}, rank int, key {told.schema['key'].dataType.simpleString()}, score bigint")
    return reduce(DataFrame.unionByName, parts)


__all__ = ["Bisection", "best_places", "impacts", "search", "terms_of"]
