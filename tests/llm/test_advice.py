"""What the first review found to do less than the whole job."""

import random

from pyspark.sql import functions as F


def _shingles(text):
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(5)), strict=False))


def _planted(n=40, words=200, seed=5):
    """Texts of random words with copies of one to four changed words each."""
    pick = random.Random(seed)
    found = []
    for i in range(n):
        base = [f"w{pick.randrange(5000)}" for _ in range(words)]
        found.append((100 * i, " ".join(base)))
        for k in range(1, 5):
            copy = list(base)
            for at in pick.sample(range(words), k):
                copy[at] = "changed"
            found.append((100 * i + k, " ".join(copy)))
    return found


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as p

    texts = _planted()
    text = dict(texts)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts] + [(9999, text[0].replace("w", "v"), "en", "s", 1)], schema)
    kept = {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()}
    root = {i: i for i in text}
    for _ in range(5):
        for i in text:
            for j in range(i - i % 100, i):
                if j in text:
                    a, b = _shingles(text[i]), _shingles(text[j])
                    if len(a & b) >= 0.8 * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
    assert len(set(root.values())) == 40
    assert kept == set(root.values()) | {9999}


def test_crowded_buckets_lose_no_link(spark):
    # one group in which most pairs are less similar than 0.8 and links go by chains
    from promptlake.llm import similar

    pick = random.Random(7)
    words, texts = [f"w{i}" for i in range(120)], []
    for i in range(150):
        texts.append((i, " ".join(words)))
        words[pick.randrange(120)] = f"x{i}"
    got = similar.near_copies(spark.createDataFrame(texts, "doc_id bigint, text string"), as_column="g")
    sets = [_shingles(t) for _, t in texts]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    by = {}
    for r in got.collect():
        by.setdefault(r.g, set()).add(r.doc_id)
    assert {frozenset(x) for x in by.values()} == {frozenset(i for i in range(150) if root[i] == r) for r in root}


def test_very_long_labelled_text(spark):
    import numpy as np

    from promptlake.llm import quality_knn

    texts = ["plain words of a plain text " * 20_000] + [f"number {i} is told in plain words here" for i in range(20)] + [f"BUY!!! {i} NOW### $$$ {i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i <= 20)) for i in range(len(texts))], "doc_id bigint, quality int")
    model = quality_knn.train(docs, labels, F.lit(True))
    assert np.isfinite(model["directions"]).all() and np.isfinite(model["vectors"]).all()
    got = {r.doc_id: r.quality for r in quality_knn.score(docs, model).collect()}
    assert min(got[i] for i in range(1, 21)) > model["base"] > max(got[i] for i in range(21, 41))


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as p

    a, b, c, d = ("".join(f"{x}{i} " for i in range(60)) for x in "abcd")
    data = [(1, a), (2, a), (2, b), (2, c), (None, a), (None, d), (None, d), (3, d + "x"), (None, None), (None, ""), (None, b), (7, c), (7, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (2, c), (3, d + "x"), (None, None)], key=repr)
