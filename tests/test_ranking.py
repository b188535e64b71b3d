"""Fused ranks and mandatory inclusion against brute force."""

import random


def _ranked(items):
    """rank, id, scores of each item's five best, by brute force."""
    import math
    from collections import Counter

    def place(word):
        h = 0
        for c in word:
            h = (h * 31 + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
        return abs(h) % 32

    words = {i: t.lower().split() for i, t in items}
    vector = {i: [sum(place(w) == d for w in ws) for d in range(32)] for i, ws in words.items()}
    cosine = lambda a, b: sum(map(lambda x, y: x * y, a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    weight = lambda tf, w, n: math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    out = {}
    for q, asked in words.items():
        dense = {j: cosine(vector[q], vector[j]) for j in words}
        lexical = {j: sum(weight(ws.count(w), w, len(ws)) for w in asked if w in ws) for j, ws in words.items() if set(ws) & set(asked)}
        d = {j: r for r, j in enumerate(sorted(dense, key=lambda j: (-round(dense[j], 12), j))[:10], 1)}
        x = {j: r for r, j in enumerate(sorted(lexical, key=lambda j: (-round(lexical[j], 12), j)), 1)}
        score = {j: (1 / (60 + d[j]) if j in d else 0) + (1 / (60 + x[j]) if j in x else 0) for j in d.keys() | x.keys()}
        best = sorted(score, key=lambda j: (-round(score[j], 14), d.get(j, 999), x.get(j, 999), j))[:5]
        out |= {(q, j): (r, round(dense[j] if j in d else 0, 6), round(lexical.get(j, 0), 5), round(score[j], 8)) for r, j in enumerate(best, 1)}
    return out


def test_every_item_is_a_query(spark, tmp_path):
    from promptlake.operators import scoring
    from promptlake.plans import queries_store

    pick = random.Random(3)
    items = [(i, " ".join(f"t{pick.randrange(60)}" for _ in range(pick.randrange(8, 30)))) for i in range(25)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    wanted = _ranked(items)
    got = {(r.query_id, r.id): (r.rank, r.dense_score, r.lexical_score, r.rrf_score) for r in queries_store.rrf_fusion(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == wanted.keys()
    assert all(abs(x - y) < 2e-5 for key in got for x, y in zip(got[key], wanted[key], strict=True))
    added = {r.query_id: (r.n, r.n_added) for r in queries_store.mandatory_inclusion(spark, f"file://{tmp_path}").collect()}
    assert added == {q: (5 + m, m) for q in range(25) for m in [sum((q, j) not in wanted for j in range(3))]}



def test_blocks_find_the_best_of_all_pairs(spark):
    import math

    from promptlake.operators import scoring

    pick = random.Random(4)
    rows = [(i, [float(pick.randrange(-3, 4)) for _ in range(4)]) for i in range(60)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cosine = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))) if dot(a, a) * dot(b, b) else 0.0
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = vectors.withColumnRenamed("id", "query_id")
    for minimum in (-1.0, 0.45):
        wanted = set()
        for q, a in rows:
            best = sorted((-round(cosine(a, b), 12), j) for j, b in rows if cosine(a, b) >= minimum)[:7]
            wanted |= {(q, j, r) for r, (_, j) in enumerate(best, 1)}
        found = scoring.dense_top_blocks(asked, vectors, k=7, minimum=minimum, block=9)
        assert {(r.query_id, r.id, r.dense_rank) for r in found.collect()} == wanted


def test_words_are_found_where_they_are_scored(spark):
    from promptlake.functions.text import tokens_ascii
    from promptlake.operators import scoring

    queries = spark.createDataFrame([(1, "A b, b c"), (2, None), (3, "z"), (4, "İd B-a"), (4, "b"), (5, "")], "query_id long, text string")
    chunks = spark.createDataFrame([(10, "a b"), (11, "b b d"), (12, None), (13, "c a a")], "chunk_id long, text string")
    told = scoring.bm25(queries, chunks)
    # an unknown function's words travel as arrays, and both give the same doubles
    arrays = scoring.bm25(queries, chunks, words=lambda c: tokens_ascii(c))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, arrays.collect()))
    split = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert (split(told), split(arrays) > 0) == (0, True)
    nothing = scoring.bm25(queries, chunks.where("chunk_id = 12"))
    assert nothing.count() == 0
