"""What the operators must do beyond their contracts: no signal, unseen layouts, cold and warm caches, several sets."""

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from promptlake.llm import ann, decontaminate, html_extract, langid, quality_knn, token_count, toxicity
from promptlake.llm.base import held_out, new_path
from promptlake.llm.queries import QUERIES, page_model

SMALL = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = ["the river runs past the old mill", "bread and butter are on the table", "a long walk in the quiet woods", "rain fell on the roof all night"]


def learned(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(len(texts))], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    return model, {r.doc_id: r.s for r in toxicity.score(docs.unionByName(spark.createDataFrame([(-1, "")], docs.schema)), model, as_column="s").collect()}


def test_toxicity_without_signal(spark):
    model, got = learned(spark, [PLAIN[i % 4] for i in range(200)], {0, 1, 2})
    assert not any(s >= 0.5 for s in got.values())
    assert got[-1] == pytest.approx(3 / 200)


def test_toxicity_with_one_positive(spark):
    texts = [PLAIN[i % 4] + f" {i}" for i in range(200)]
    texts[7] = "you filthy zorgling filthy zorgling go away"
    _, got = learned(spark, texts, {7})
    assert sum(s >= 0.5 for i, s in got.items() if i != 7) <= 2


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", SMALL])
def test_toxicity_leaves_clean_texts_alone(spark, sf_dir):
    toxic = dict(zip(*(pq.read_table(f"{sf_dir}/labels.parquet")[c].to_pylist() for c in ("doc_id", "toxic")), strict=True))
    got = QUERIES["op1_toxicity"](spark, sf_dir).collect()
    clean = [r.predicted for r in got if r.held_out and toxic.get(r.doc_id) == 0]
    assert np.mean(clean) <= 0.05


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for name, stage in p.STAGES:
        before = docs.count()
        docs = p.stored(stage(spark, docs, SMALL), f"test-{name}")
        kept.append(docs.count() / before)
    assert kept[0] >= 0.98 and kept[1] >= 0.8 and kept[2] >= 0.5 and kept[3] >= 0.8 and kept[4] == 1


def test_quality_scores_the_same_with_a_long_labelled_text(spark):
    good, bad = [f"{PLAIN[i % 4]} number {i}" for i in range(60)], [f"CLICK!!! {i} ### $$$ WIN {i} !!!" for i in range(60)]
    told = []
    for long in (good[0], "plain words of a plain text " * 40_000):
        docs = spark.createDataFrame(list(enumerate([long, *good[1:], *bad])), "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int")
        model = quality_knn.train(docs, labels, F.lit(True))
        told.append({r.doc_id: r.quality for r in quality_knn.score(docs, model).where("doc_id > 0").collect()})
    assert all((told[0][i] > 0.5) == (told[1][i] > 0.5) == (i < 60) for i in told[0])


def test_quality_hears_words(spark):
    # the same signs and lengths on both sides: only the words differ
    texts = [" ".join((("meadow", "garden", "orchard") if i % 2 else ("casino", "jackpot", "bonuses"))[(i + j) % 3] for j in range(9)) + "." for i in range(200)]
    texts = [t.replace("meadow", "meadows").replace("orchard", "orchids") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id bigint, quality int")
    model = quality_knn.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.quality for r in quality_knn.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(150, 200))


def test_a_screened_benchmark_finds_what_one_automaton_does(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    found = [
        {r.doc_id: (r.c.n_words, r.c.n_hit, tuple(r.c["items"]), tuple(map(tuple, r.c.spans))) for r in decontaminate.contamination(docs, items, as_column="c", **bounds).collect()}
        # all windows; those that occur; those in two passes; those in several sets
        for bounds in ({}, {"max_window_words": 15_000}, {"max_window_words": 15_000, "max_screened": 700}, {"max_window_words": 3_000})
    ]
    assert any(x[1] for x in found[0].values())
    assert all(f == found[0] for f in found)


def test_a_benchmark_of_any_size_is_one_automaton_of_what_occurs(spark, monkeypatch):
    """Four thousand items, a bound of 20 words: only the window that occurs is built, and the documents aren't written."""
    sent = []
    monkeypatch.setattr(decontaminate, "_scanned", lambda key, told, text, before=None, f=decontaminate._scanned: sent.append(told.value) or f(key, told, text, before))
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"never{i} seen{i} words{i}") for i in range(4000)] + [(-1, "two three four")], "item_id bigint, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.contamination(docs, items, max_window_words=20).collect()}
    assert sent == [{"two three four": ["-1"]}]
    assert (got[1].n_hit, got[1]["items"], got[2].n_hit) == (3, ["-1"], 0)


def test_pages_give_their_article():
    """Exactly the article's text, on all pages of the largest of the small tables."""
    model = page_model()
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist()
    article = [(h, re.findall(r"(?s)<article[^>]*>(.*?)</article>", h or "")) for h in pages]
    whole = [(h, " ".join(b.text for a in x for b in html_extract.blocks(a))) for h, x in article if x]
    assert len(whole) == len(pages) == 2500
    assert sum(model.extract(h) == text for h, text in whole) >= 2495


ONE = "The committee met on Tuesday to discuss the plan for the new bridge across the river, which has been delayed for years."
TWO = "Several members said that the cost had risen far beyond what was expected when the first drawings were made public."


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f"<html><head><title>x</title><article><p>{ONE}<p>{TWO}</article>", f"{ONE} {TWO}"),
        (f"<title>x</title><p>{ONE}<p>{TWO}", f"{ONE} {TWO}"),
        (f"<html><head><meta charset=utf-8><title>x</title>{ONE} {TWO}", f"{ONE} {TWO}"),
        (f"<head><style>p {{ top: 0 }}</style><script>var a = '<p>';</script><main><p>{ONE}<p>{TWO}</main>", f"{ONE} {TWO}"),
        (f"<body><button>Menu<article><p>{ONE}<p>{TWO}</article>", f"{ONE} {TWO}"),
        (f"<body><article><p>{ONE}</p><button>Like</button><p>{TWO}</article>", f"{ONE} {TWO}"),
        (f"<body><article><p>{ONE} Press <button type=button>Start</button> to begin.<p>{TWO}</article>", f"{ONE} Press Start to begin. {TWO}"),
        (f"<body><article><p>{ONE} The area is <math>x=2</math> units.<p>{TWO}</article>", f"{ONE} The area is x=2 units. {TWO}"),
        (f"<body><article><p>{ONE} So <math><mfrac><mi>a</mi><mi>b</mi></mfrac><mspace/><annotation>frac</annotation></math> holds.<p>{TWO}</article>", f"{ONE} So ab holds. {TWO}"),
        (f"<body><article><p>{ONE} <span hidden>not seen</span><p>{TWO}<svg><title>t</title></svg></article></html>", f"{ONE} {TWO}"),
        (f"<article><p>{ONE}<ul><li>{TWO}<li>{ONE}</ul>", f"{ONE} {TWO} {ONE}"),
    ],
)
def test_tags_left_out_and_formulas(page, wanted):
    assert page_model().extract(page) == wanted


UNSEEN = """<body><div class=wrap><table class="layout"><tr><td class="rail"><ul><li><a href=1>Start</a><li><a href=2>News</a><li><a href=3>Sport</a></ul></td>
<td><div data-title="The hidden cost"><h2>Where the old line ended</h2><div>The railway stopped here for sixty years, and nobody in the valley thought that it would ever run again.</div>
<div>Then, one morning in spring, the first engine came through the cutting and the whole village went to look at it.</div></div></td></tr></table>
<div style="display: none">Nobody sees this sentence at all, it is not shown.</div>
<div class="cookie-bar">We use cookies. <button>Accept</button></div><div class="foot">&copy; 2021 Valley Press. All rights reserved.</div></div></body>"""


def test_unseen_layout():
    got = page_model().extract(UNSEEN)
    assert "railway stopped here" in got and "first engine came" in got and "old line ended" in got
    assert not any(x in got for x in ("Sport", "cookies", "rights reserved", "Nobody sees"))


def test_token_cache_is_warm_the_second_time(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id bigint, text string")
    cache = new_path(spark, "warm")
    sizes = []
    for more in (docs, docs, docs.unionByName(spark.createDataFrame([(99, "new")], docs.schema))):
        assert token_count.token_counts(more, BPE, cache).where("n_tokens IS NULL").isEmpty()
        sizes.append(spark.read.parquet(cache).count())
    assert sizes == [7, 7, 8]


def test_neighbours_of_any_width_and_without_queries(spark):
    line = spark.createDataFrame([(i, [float(i)]) for i in range(1, 41)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): r.id for r in ann.search(line, F.col("id") % 20 == 0, k=3).collect()}
    assert got == {(20, 1): 40, (20, 2): 39, (20, 3): 38, (40, 1): 39, (40, 2): 38, (40, 3): 37}
    assert ann.search(line, F.lit(False)).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "vec_id bigint, embedding array<double>")
    found = sorted((r.rank, r.id) for r in ann.search(ties, F.col("id") == 100, k=5).collect())
    assert found == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_neighbours_visit_few_rows_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index, table, n = ann.build(ann.usable(df, "vec_id", "embedding"))
    enough = ann.enough_candidates(index, table, F.col("id") % 20 == 0, 20, 0.93, 32)
    assert n == 4000 and enough < 0.3 * n


def fused_by_hand(spark, sf_dir):
    """The fusion of op6 in numpy, from the same text likelihoods."""
    from promptlake.llm import url_filter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    n = len(model["languages"]) + 1
    prior = np.log([(1 - langid.UNKNOWN) / (n - 1)] * (n - 1) + [langid.UNKNOWN])
    text = [re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", h or "") for h in pages["html"]]
    df = spark.createDataFrame(list(enumerate(text)), "i bigint, text string")
    log = {r.i: r.x for r in df.select("i", langid.likelihood(F.col("text"), model, spark).alias("x")).collect()}
    urls = spark.createDataFrame(list(enumerate(pages["url"])), "i bigint, url string")
    hosts = {r.i: r.h for r in urls.select("i", url_filter.host(F.col("url")).alias("h")).collect()}
    rows = []
    for i, h in enumerate(pages["html"]):
        m = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", h or "")
        rows.append((None if log[i] is None else np.array(log[i]), hosts[i] or None, hosts[i].rsplit(".", 1)[-1] if hosts[i] else None, m[1].lower() if m else None))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    own = [None if x is None else softmax(x + prior) for x, *_ in rows]
    sums = [{}, {}, {}]
    for o, r in zip(own, rows, strict=True):
        for k in range(3):
            if o is not None and r[k + 1] is not None:
                sums[k][r[k + 1]] = sums[k].get(r[k + 1], 0) + o
    corpus = sum((o for o in own if o is not None), np.zeros(n)) + 1
    smooth = lambda c, p: (c + langid.STRENGTH * p) / (c.sum() + langid.STRENGTH)
    out = []
    for o, (x, host, suffix, declared) in zip(own, rows, strict=True):
        share = corpus / corpus.sum()
        if suffix in sums[1]:
            share = smooth(sums[1][suffix], share)
        if host in sums[0]:
            share = smooth(np.maximum(sums[0][host] - o, 0) if o is not None else sums[0][host], share)
        score = np.log(np.maximum(share, 1e-6))
        if x is not None:
            score = score + x
        if declared in sums[2]:
            score = score + np.log((sums[2][declared] + 0.5) / (corpus + 1))
        out.append(softmax(score))
    return pages, model, out


def test_language_of_pages_is_the_fusion(spark):
    pages, model, wanted = fused_by_hand(spark, SMALL)
    got = {r.page_id: r for r in QUERIES["op6_language_id"](spark, SMALL).collect()}
    names = [*model["languages"], langid.UND]
    for i, p in zip(pages["page_id"], wanted, strict=True):
        assert got[i].lang == names[p.argmax()] and abs(got[i].probability - p.max()) < 1e-5
    # what the page itself declares, where it does, is the truth here
    told = [(m[1].lower(), got[i].by_text) for i, h in zip(pages["page_id"], pages["html"], strict=True) if (m := re.search(r"<html[^>]* lang=\"?([a-z]{2})", h or ""))]
    if told:
        assert np.mean([a == b for a, b in told]) >= 0.9


def test_language_without_evidence_and_with_clashing_names(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    rows = [("der Wald ist still und die Luft ist kalt " * 3, "a.de", "de", "x"), (None, None, None, None), ("", "a.de", "de", None), (None, "b.fr", "fr", "de")] * 2
    df = spark.createDataFrame(rows, "text string, host string, declared string, suffix string")
    for name in ("loglik__", "own__", "host__", "language"):
        df = df.withColumn(name, F.lit("mine"))
    answers = []
    for most in (langid.MAX_SENT_BYTES, -1):  # sums sent to every task, or joined by a shuffle
        monkeypatch.setattr(langid, "MAX_SENT_BYTES", most)
        out = langid.identify(df, model, host="host", suffix="suffix", declared="declared", as_column="told")
        assert out.columns == [*df.columns, "told"] and out.where("own__ = 'mine' AND host__ = 'mine' AND language = 'mine'").count() == 8
        answers.append(sorted((r.text or "", r.host or "", r.told.lang, round(r.told.probability, 9), r.told.accepted) for r in out.collect()))
    assert answers[0] == answers[1]
    none = [x for x in answers[0] if not x[0] and not x[1]]
    assert all(x[2] == langid.UND and not x[4] for x in none)


def test_simhash_of_one_dense_group(spark):
    from promptlake.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:i] + ["odd"] + words[i + 1 :]) for i in range(0, 400, 2)]
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sparse, dense = ({(r.doc_id, r.mark, r.component_id) for r in simhash.near_duplicates(docs, shingle=3, dense=d).collect()} for d in (10_000, 3))
    assert sparse == dense


@pytest.mark.parametrize("name", ["op1_toxicity", "op10_quality"])
def test_held_out_ids(spark, name):
    rows = QUERIES[name](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).select("doc_id", "held_out", held_out(*((0, 5) if name[2] == "1" and name[3] == "_" else (2, 4))).alias("h")).collect()
    assert all(r.held_out == r.h for r in rows)


def test_rows_of_one_id_have_neighbours_of_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    ids = [20, 20, *range(1, 20), *range(21, 39), 40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id) for r in ann.search(df, F.col("id") == 20, k=3, recall=1.0).collect())
    wanted = []
    for row in (0, 1):
        score = x @ x[row]
        score[row] = -np.inf
        wanted += [(20, rank + 1, ids[j]) for rank, j in enumerate(np.argsort(-score)[:3])]
    assert got == sorted(wanted)


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall_of_all_queries(spark, folder):
    """Brute force over the whole table; few of sf0.1's queries took part in the calibration."""
    told = pq.read_table(f"{folder}/embeddings.parquet")
    ids = told["vec_id"].to_numpy()
    x = np.stack([np.array(v, np.float64) for v in told["embedding"].to_pylist()])
    score = x[ids % 20 == 0] @ x.T
    score[ids[ids % 20 == 0][:, None] == ids[None, :]] = -np.inf
    truth = {q: set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for q, s in zip(ids[ids % 20 == 0].tolist(), score, strict=True)}
    found = {q: set() for q in truth}
    for r in QUERIES["op5_nearest_neighbours"](spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    assert all(len(f) == 20 for f in found.values())
    assert sum(len(found[q] & truth[q]) for q in truth) / (20 * len(truth)) >= 0.9
