"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import json
import random
import tracemalloc

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from promptlake.llm import ann, bpe, decontaminate, html_extract, langid, quality_knn, simhash, token_count, toxicity, url_filter
from promptlake.llm.base import held_out, new_path
from promptlake.llm.queries import RULES, page_model

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, key string, mark string, content string, h string, language string, score string"
LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 20_000
TEXTS = [None, "", " \t\n", "a", "A b c", "Ünïcode — 漢字 <|endoftext|> 🙂\x00 x", "word " * 40, LONG, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("k", "m", "c", "h", "l", "s")
    data = [(i, t, "en" if t else None, "s1" if i % 2 else None, *extra) for i, t in enumerate(TEXTS)]
    data += [(None, "null id", "en", "s1", *extra), data[3], data[3]]
    return spark.createDataFrame(data, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (8, 0, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_classifiers(docs, none, labels):
    for module in (toxicity, quality_knn):
        for train in ((docs, labels), (docs, labels.limit(0)), (none, labels)):
            model = module.train(*train, ~held_out(0, 5))
            out = module.score(docs, model, as_column="told")
            assert out.columns == [*docs.columns, "told"]
            assert all(0 <= r.told <= 1 for r in out.collect())
            assert len({r.told for r in out.where("doc_id = 3").collect()}) == 1
            assert module.score(none, model).count() == 0


def test_pages(spark):
    cases = {
        None: "",
        "": "",
        "<html><body><nav><a href=/>Home</a></nav><article><h1>Big &amp; small</h1><p>First   paragraph\n of the story, long enough to read.</p>"
        "<p>Second paragraph of the story, which ends here.</p><script>x<y</script></article><footer>Copyright 2020 Somebody</footer></body></html>": "Big & small First paragraph of the story, long enough to read. Second paragraph of the story, which ends here.",
    }
    df = spark.createDataFrame([(k, "x") for k in cases] * 2, "html string, main_text string")
    got = html_extract.extract(df, page_model(), as_column="told").collect()
    assert [r.told for r in got] == [*cases.values()] * 2
    assert page_model().extract("<p>" * 3000 + "x") is not None
    assert html_extract.extract(df.limit(0), page_model()).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("i1", TEXTS[8]), ("i2", "A  b. C"), ("i3", None), ("i4", "..."), (None, "word")], "item_id string, text string")
    for bound in (20_000_000, 20):  # one automaton, and several
        got = {r.doc_id: r.contamination for r in decontaminate.contamination(docs, items, max_window_words=bound).collect()}
        assert (got[8].n_words, got[8].n_hit, got[8].items) == (14, 14, ["i1"])
        assert (got[4].n_hit, got[4].items, got[0].n_words) == (3, ["i2"], 0)
        assert [tuple(s) for s in got[4].spans] == [(0, 5)]
        # an item without an id hits words but can't be named
        assert (got[6].n_words, got[6].n_hit, got[6].items) == (40, 40, [])
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.clean(none, items).count() == 0


def test_encoding(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.round_trip(none, BPE).count() == 0


def test_pieces_cache_starts_afresh():
    codec = bpe.Codec.of("test", bpe.read_spec(BPE))
    small = object.__new__(bpe.Codec)
    small.__dict__ = codec.__dict__ | {"memory": 3, "used": 0, "known": {}}
    for t in ("one two three four five", "six seven one two", "it's 12345 a\n\n b", "x" * 500 + " y " + "-" * 300):
        assert small.encode(t).tolist() == codec.encode(t).tolist()
        assert len(small.known) <= 6 and all(len(p) <= bpe.LONGEST for p in small.known)
    assert bpe.Codec.of("test", "never read") is codec
    other = bpe.Codec.of("other", bpe.read_spec(BPE))
    assert bpe.Codec.last == ("other", other)


def test_token_cache(spark, docs, none):
    cache = new_path(spark, "test-cache")
    first = token_count.token_counts(docs, BPE, cache, as_column="n").collect()
    size = spark.read.parquet(cache).count()
    assert size == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_count.token_counts(docs.unionByName(docs), BPE, cache, as_column="n").collect()
    assert spark.read.parquet(cache).count() == size and len(again) == 2 * len(first)
    assert {r.doc_id: r.n for r in again} == {r.doc_id: r.n for r in first}
    assert next(r.n for r in first if r.doc_id == 0) == 0
    assert token_count.token_counts(none, BPE, new_path(spark, "test-empty")).count() == 0
    model = token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert model.where("n_tokens > 0").count() > 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    vectors = {0: [1.0, 0.0, 0.0, 0.0], 20: [1.0, 0.0, 0.0, 0.0], 1: [1.0, 0.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0, 0.0], 3: [nan, 1.0, 1.0, 1.0], 4: [inf, 1.0, 1.0, 1.0], 5: None, 6: [1.0, None, 1.0, 1.0], 7: [2.0, 1.0, 0.0, 0.0]}
    df = spark.createDataFrame([(k, v, 1, 2, "q") for k, v in vectors.items()], "vec_id bigint, embedding array<double>, row int, column int, v string")
    got = {(r.query_id, r.rank): r.id for r in ann.search(df, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 1): 7, (0, 2): 1, (0, 3): 20, (20, 1): 7, (20, 2): 0, (20, 3): 1}
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id IN (2, 5)"), F.col("id") % 20 == 0).count() == 0


def test_language(docs, none):
    model = langid.train(docs)
    out = langid.identify(docs, model, host="source", as_column="told")
    assert out.columns == [*docs.columns, "told"] and out.count() == docs.count()
    got = {r.doc_id: r.told for r in out.collect()}
    assert not got[0].accepted and not got[1].accepted and got[7].lang == "en"
    assert langid.identify(none, langid.train(none)).count() == 0


@pytest.mark.parametrize("dense", [64, 2])
def test_simhash_ways_agree(spark, dense):
    base = 0x0123456789ABCDEF
    marks = [base ^ (1 << b) for b in range(12)] + [base ^ (1 << b) ^ (1 << (b + 20)) ^ (1 << (b + 40)) ^ (1 << 63) for b in range(6)] + [0, 1, 3, 7]
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    edges = simhash.links(spark.createDataFrame(signed, "mark bigint"), dense=dense)
    from promptlake.llm.components import connected

    root = {m: m for (m,) in signed} | {r.node: r.root for r in connected(edges).collect()}
    groups = lambda of: {frozenset(m for m in of if of[m] == x) for x in of.values()}
    plain = {m: m for (m,) in signed}
    for _ in plain:
        for a in plain:
            for b in plain:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    plain[a] = plain[b] = min(plain[a], plain[b])
    assert groups(root) == groups(plain)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, shingle=3)
    assert got.count() == docs.count()
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert by[0] == by[1] == by[2] == 0 and by[3] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme.com": ("", "", None, "allow"),
        "https://EXAMPLE.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
        "http://a.org/porn": ("a.org", "/porn", None, "block"),
        "http://a.org/alphabets": ("a.org", "/alphabets", None, "allow"),
        "http://a.org/bet/bet": ("a.org", "/bet/bet", None, "allow"),
        "http://a.org/bet-bonus": ("a.org", "/bet-bonus", None, "block"),
    }
    df = spark.createDataFrame([(k, "x", "y") for k in cases], "url string, host string, rule string")
    got = url_filter.judge(df, RULES).collect()
    assert [(r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in got] == [*cases.values()]
    assert [r.host for r in got] == ["x"] * len(cases)
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_stages(spark, docs, none, sf_dir):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() <= docs.count()
        if name != "bpe":  # columns named like those that stages make stay as they are
            mine = docs.withColumns({c: F.lit("mine") for c in ("language__", "toxicity__", "text__", "row__", "contamination")})
            out = stage(spark, mine, sf_dir)
            assert out.columns == mine.columns and out.where("language__ <> 'mine' OR toxicity__ <> 'mine' OR text__ <> 'mine' OR row__ <> 'mine' OR contamination <> 'mine'").isEmpty()


def test_pieces_met_again_are_not_merged_again(monkeypatch):
    codec = bpe.Codec(json.loads(bpe.read_spec(BPE)), memory=4000)
    merged, merge = [], codec.merge
    monkeypatch.setattr(codec, "merge", lambda raw: merged.append(raw) or merge(raw))
    for i in range(200):
        codec.encode(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)}")
        assert codec.used <= codec.memory
    assert merged.count(b"the") == 1


def test_codec_holds_no_object_a_merge_and_joins_as_the_library():
    from tokenizers import Tokenizer

    spec = json.loads(bpe.read_spec(BPE))
    tracemalloc.start()
    codec = bpe.Codec(spec)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 180 * len(codec.rule)
    library, some = Tokenizer.from_file(BPE), random.Random(7)
    parts = ["ung", "queue", "tion", "\xe9", "\xe8\xe8", "der", "aaaa", "x", "\u0635", "\U0001f600", "9", " ", "!!", "'s", "\n", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(some.choices(parts, k=some.randrange(1, 40)))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
