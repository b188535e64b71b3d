"""Dictionaries of many terms against one pattern of all terms."""

import random

import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from promptlake.functions import detectors, lexicon
from promptlake.plans.queries_text import QUERIES

ZWNJ = "‌"


def by_pattern(text, terms):
    """The same spans by one alternation, longest term first."""
    kept = sorted((t.strip() for t in terms if len(t.strip()) >= 2), key=len, reverse=True)
    return [(m.start(), m.end()) for m in regex.finditer("|".join(lexicon.spelled(t).pattern for t in kept), text, regex.IGNORECASE)] if kept else []


def by_lexicon(text, terms):
    return [(x["start"], x["end"]) for x in lexicon.chosen(lexicon.Lexicon([(0, t.strip(), i) for i, t in enumerate(terms) if len(t.strip()) >= 2]).candidates(text))]


@pytest.mark.parametrize(
    ("terms", "text"),
    [
        (["ab", "abc", "bcd"], "abcd ABc xabx"),
        (["a b", "b c"], f"a b c a{ZWNJ}b  a \t b"),
        (["x-y", "xy z"], f"x-y xy x{ZWNJ}y x y xy z X-Y"),
        (["یک", "کی ی"], "يك یک کي ي"),
        (["a-b-c-d-e-f-g"], "abcdefg a-b-cd-efg"),
        (["ähre", "straße"], "Ähre ähre Straße STRAßE"),
        (["  ", "q", ""], "q q"),
        ([f"p{ZWNJ}q"], f"p{ZWNJ}q p q pq"),
    ],
)
def test_spellings(terms, text):
    assert by_lexicon(text, terms) == by_pattern(text, terms)


def test_random_texts_and_terms():
    rng = random.Random(9)
    letters = ["a", "b", "c", " ", "-", ZWNJ, "ی", "ي", "ك", "ک", "\n", "A"]
    for _ in range(400):
        terms = ["".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(6)]
        # patterns don't match nothing, and a term has no blanks or joiners at its ends
        terms = [t for t in terms if t.strip() == t and not set(t) & {ZWNJ, "\n"} and t.strip("- ") and "  " not in t]
        text = "".join(rng.choices(letters, k=40))
        assert by_lexicon(text, terms) == by_pattern(text, terms), (terms, text)


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(3)
    terms = [f"w{rng.randrange(10**6)} v{rng.randrange(10**6)}" for _ in range(100_000)]
    text = " ".join(f"{rng.choice(terms)} filler" for _ in range(50)) + " w1 v-1"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    known = {"PROPRIETARY_SERVICE": terms, "SENIOR_OFFICER": ["filler w"]}
    got = [r.h for r in df.select(detectors.dictionary(F.col("t"), known).alias("h")).collect()]
    services = [(h.start, h.end) for h in got[0] if h.category == "proprietary_service"]
    assert services == by_pattern(text, [t for t in terms if t in text]) and len(services) >= 50
    assert [h.text for h in got[0] if h.category == "senior_officer"] == ["filler w"] * 50
    assert got[1] == got[2] == []


def test_both_ways_and_several_sets_find_the_same(spark):
    terms = {"TELCO_HUB_NODE": ["apache-license", "version 2.0"], "PROPRIETARY_SERVICE": ["licensed under", "copy", "copyright"], "SENIOR_OFFICER": ["the thand"]}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spans = F.transform("h", lambda h: F.struct(h["category"], h["start"], h["end"], h["text"]))
    ways = [docs.select("doc_id", detectors.dictionary(F.col("text"), terms, pattern_terms=n).alias("h")).select("doc_id", spans.alias("h")).where("size(h) > 0") for n in (200, 0)]
    one, two = ({r.doc_id: r.h for r in way.collect()} for way in ways)
    assert one == two and one
    listed = [(0, "copy"), (0, "copyright"), (1, "licensed under"), (1, "right")]
    df = spark.createDataFrame([("Copyright licensed  under copyright",)], "t string")
    whole, cut = (df.select(lexicon.term_spans(F.col("t"), listed, max_terms=n).alias("s")).first().s for n in (100, 1))
    assert whole == cut and [s.text for s in whole] == ["Copyright", "copyright", "right", "licensed  under", "right"]


def test_the_query_against_one_pattern(spark, sf_dir):
    words = [regex.findall("[a-zà-ÿ]+", (t or "").lower()) for t in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()]
    terms = {f"{a} {b}" for w in words for a, b in zip(w, w[1:], strict=False)}
    docs = pq.read_table(f"{sf_dir}/documents.parquet")
    wanted = {i: len(by_pattern(t or "", terms)) for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)}
    assert {r.doc_id: r.n for r in QUERIES["dictionary_terms"](spark, sf_dir).collect()} == {i: n for i, n in wanted.items() if n}


def test_plain_terms_need_no_pattern(spark, sf_dir, monkeypatch):
    from promptlake.functions import lexicon
    from promptlake.plans.catalogue import QUERIES

    texts = ["x AB\n cd, ab-cd", "é ab cd", "ab  cd"]
    wanted = {t: [(0, m.start(), m.end()) for m in lexicon.spelled("ab cd").finditer(t)] for t in texts}
    assert lexicon.Lexicon([(0, "ab  cd", 0)]).candidates("ab cd ab  cd") == [{"start": 6, "end": 12, "size": 6, "place": 0, "kind": 0}]
    monkeypatch.setattr(lexicon, "spelled", None)
    for said in texts:
        assert [(x["kind"], x["start"], x["end"]) for x in lexicon.Lexicon([(0, "ab cd", 0)]).candidates(said)] == wanted[said]
    plan = QUERIES["dictionary_terms"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
