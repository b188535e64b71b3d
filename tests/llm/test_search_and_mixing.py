"""Lexical search, importance resampling and mixing against brute force, and their edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm import lexical, mixing, resample

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id bigint, text string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_search(docs, items, k):
    """(item, rank, key, score) by the definition; docs of unlike (score, key)."""
    known = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    found = []
    for item, text in items:
        scores = []
        for d, c in known:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s:
                scores.append((-s, d is not None, d or 0, d))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=repr)


def topics(n_topics=8, each=60, seed=5):
    """Documents whose words are of one topic and a few common ones."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n_topics * each):
        own = [f"t{i % n_topics}w{j}" for j in rng.integers(0, 40, 30)]
        docs.append((i, " ".join(own + [f"c{j}" for j in rng.integers(0, 10, 10)])))
    return docs


def searched(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_stops_early_and_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 1)
    monkeypatch.setattr(lexical, "GROWTH", 2)
    docs = topics()
    items = [(q, f"t{q % 8}w1 t{q % 8}w2 t{q % 8}w3 c1") for q in range(8)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    report = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = searched(lexical.search(frame, spark.createDataFrame(items, "item_id bigint, text string"), k=5, report=report))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute_search(docs, items, 5)
    # every pair shares the term c1, so all would be visited without the bounds
    assert sum(report) < 8 * 8


def test_search_edges(spark):
    docs = [(1, "Alpha beta beta"), (None, "alpha beta"), (2, "alpha beta"), (3, "alpha beta"), (3, "ALPHA Beta"), (4, None), (5, ""), (6, "..."), (7, "é alpha " + "gamma " * 60_000)]
    items = [(1, "alpha ALPHA"), (1, "beta é"), (None, "gamma"), (2, None), (3, "..."), (4, "nowhere")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, key string, terms int")
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, query string")
    found = searched(lexical.search(frame, asked, k=4))
    assert found == brute_search(docs, items, 4)
    assert found == searched(lexical.search(frame, asked, k=4, max_terms=2)), "in sets of queries"
    assert lexical.search(frame.limit(0), asked).count() == 0
    assert lexical.search(frame, asked.limit(0)).columns == ["item", "rank", "key", "score"]


def test_search_shards_hold_all_rows(spark, monkeypatch):
    """Many shards, ties across all of them: the smallest ids win."""
    docs = [(i, "same words here") for i in range(400)] + [(1000 + i, f"other{i} words") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    items = [(0, "words"), (1, "same"), (2, "other7 words")]
    assert searched(lexical.search(frame, spark.createDataFrame(items, "item_id bigint, text string"), k=7)) == brute_search(docs, items, 7)


def test_shards_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "SHARD_DOCS", 3)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 5)
    rows = [[1, 2], [2], [1, 2, 3, 4, 5, 6, 7], [1], [1], [1], [1], [9]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([9] * 8), pa.array(rows, pa.list_(pa.int32())), pa.array([[1] * len(r) for r in rows], pa.list_(pa.int64()))], names=["key", "n", "terms", "tfs"])
    built = list(lexical._shards(8, 72)(iter([batch.slice(0, 5), batch.slice(5)])))
    keys = [b.column(0)[0].as_py() for b in built]
    assert sorted(sum(keys, [])) == list(range(8))
    assert all(len(k) <= 3 for k in keys)
    assert all(len(b.column(4)[0].as_py()) // 4 <= 5 or len(b.column(0)[0]) == 1 for b in built)


def test_bisection_puts_like_documents_together():
    docs = topics(n_topics=4, each=100)
    number = {}
    ids = [np.array([number.setdefault(t, len(number)) for t in sorted(set(terms(x)))]) for _, x in docs]
    tree = lexical.Bisection.fit(ids[:240], depth=2)
    by_leaf = defaultdict(Counter)
    for i, own in enumerate(ids):
        by_leaf[tree.place(own)[0]][i % 4] += 1
    assert sum(c.most_common(1)[0][1] for c in by_leaf.values()) > 0.9 * len(docs)


def brute_draw(docs, items, shortest, longest, buckets, least, percent, seed):
    def features(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in items:
        t.update(features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, features(x)))
        rows.append((d, len(terms(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    n = len(long) * percent // 100
    return sorted([(*r, i + 1 if i < n else None) for i, r in enumerate(long)] + [(*r, None) for r in rows if r[1] < least], key=repr)


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 2), (2, 3)])
def test_resampling(spark, monkeypatch, shortest, longest):
    monkeypatch.setattr(resample, "PART", 40)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"W{x}" for x in rng.integers(0, 60, rng.integers(0, 40)))) for i in range(200)]
    docs += [(None, "w1 w2 " * 15), (200, None), (201, ""), (202, "- -"), (203, "é" * 300 + " w1 " * 30)]
    items = ["w1 w2 w3 w4 w1", None, "", "w5"]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, score int")
    target = spark.createDataFrame([(t,) for t in items], "text string")
    drawn = resample.resample(frame, target, shortest=shortest, longest=longest, buckets=1000, least_words=5, percent=30)
    got = sorted(((r.key, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in drawn.collect()), key=repr)
    assert got == brute_draw(docs, items, shortest, longest, 1000, 5, 30, 2024)


def test_word_parts_give_whole_words(monkeypatch):
    for part in (1, 3, 7, 1000):
        monkeypatch.setattr(resample, "PART", part)
        for text in ("", "one", "  a bb  ccc dddddddddd e ", "x" * 50, "é,ü ñandú"):
            assert sum(resample.word_parts(text.encode()), []) == [t.encode() for t in terms(text)]


def test_streams_close_and_keep_every_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(resample, "PIECE", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array(["a b c", None, "a b c d e f", "z"])], names=["key", "text"])
    packed = list(resample._packed(1, 1, 100)(iter([batch])))
    assert [b.column(1)[0].as_py() for b in packed] == [[1, None, 3], [4]]
    found = [r for b in resample._gathered(np.ones(100, np.int64))(iter(packed)) for r in zip(*b.to_pydict().values(), strict=True)]
    assert found == [(1, 3, 3, 3), (None, 0, 0, 0), (3, 6, 6, 6), (4, 1, 1, 1)]


def test_resampling_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    target = spark.createDataFrame([], "text string")
    assert resample.resample(frame, target).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert [r.asDict() for r in resample.resample(one, target).select("n_features", "rank").collect()] == [{"n_features": 30, "rank": None}]


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Water-filling by bisection on the level."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(w[s] * mid, most * sizes[s]) for s in names) < total else (lo, mid)
    return {s: min(w[s] * hi, most * sizes[s]) for s in names}


def mixture(seed=1, n=600):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(min(3000, rng.lognormal(4, 1.2))), f"s{min(6, int(rng.exponential(1.5)))}") for i in range(n)]
    return rows + [(n + i, "w " * int(rng.integers(1, 90)), None) for i in range(40)]


def test_mix_meets_the_targets(spark):
    rows = mixture() + [(9001, None, "s1"), (9002, "  ", "s1"), (9003, "", None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], DOC + ", size int, mix_ string").repartition(4)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "source", "size", "mix_", "mix"}
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r.mix["size"] == len((r.text or "").split())
        assert r.mix.taken == r.mix["size"] * r.mix.copies and 0 <= r.mix.copies <= 3
        sizes[r.source] += r.mix["size"]
        taken[r.source] += r.mix.taken
        target[r.source] = r.mix.target
    wanted = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s], rel=1e-9)
        assert taken[s] == pytest.approx(wanted[s], rel=0.003, abs=2)
    assert all(r.mix.source_size == sizes[r.source] for r in found)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.mix.taken) for r in again) == sorted((r.doc_id, r.mix.taken) for r in found)
    assert mixing.copied(spark.createDataFrame(found, df.select("*", F.lit(None).cast("struct<size:bigint,source_size:bigint,target:double,copies:bigint,taken:bigint>").alias("mix")).schema)).count() == sum(r.mix.copies for r in found)


def test_multipliers_solve_the_dual(spark):
    """Against bisection: the words that the tilted rates give are the targets."""
    rng = np.random.default_rng(8)
    rows = [(s, int(z), int(n)) for s in range(1, 6) for z, n in {int(z): int(rng.integers(1, 9)) for z in rng.lognormal(4, 1.5, 60) + 1}.items()]
    words = Counter()
    for s, z, n in rows:
        words[s] += z * n
    share = {1: 0.02, 2: 0.7, 3: 1.0, 4: 2.5, 5: 3.0}
    classes = spark.createDataFrame(rows, "source_no bigint, size bigint, n bigint")
    sources = spark.createDataFrame([(s, share[s] * words[s]) for s in words], "source_no bigint, target double")
    for r in mixing.multipliers(classes, sources, 3).collect():
        own = [(z, n) for s, z, n in rows if s == r.source_no]
        reached = lambda lam: sum(z * n * math.exp(min(math.log(3), lam * z / r.scale)) for z, n in own)
        assert reached(r.lam) == pytest.approx(r.target, rel=2e-6)


def test_large_classes_are_split_exactly(spark, monkeypatch):
    """One class holds most rows: its copies are dealt over ranges of hashes, and not one is lost."""
    monkeypatch.setattr(mixing, "ORDERED", 50)
    rows = [(i, "a b c", "x") for i in range(1500)] + [(5000 + i, "a " * 7, "y") for i in range(900)]
    found = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.mix.taken
    for s, t in brute_targets({"x": 4500, "y": 6300}).items():
        assert abs(taken[s] - t) <= 8


def test_mix_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], DOC)).select("mix.*").collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0), (0, 0.0, 0)]
    same = spark.createDataFrame([(None, "a b", "a")] * 30 + [(1, "a b c", "b")] * 30, DOC)
    found = mixing.mix(same).groupBy("source").agg(F.countDistinct("mix.copies").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n == 1 and r.rows == 30 for r in found), "rows equal in id and text are taken alike"
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "a"), (2, "d", "a")], DOC)).select("mix.*").collect()
    assert sum(r.taken for r in one) == 4


def test_mix_is_native(spark):
    from promptlake.llm import queries

    plan = queries.op13_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
