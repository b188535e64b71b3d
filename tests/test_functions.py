"""Known values of checksums and normalisation."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from promptlake.functions import checksums, text


def value(spark, said, column):
    return spark.createDataFrame([(said,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("۰۱۲۳۴۵۶۷۸۹", "0123456789"), ("٠١٢٣٤٥٦٧٨٩", "0123456789"), ("HeLLo", "hello"), ("a\n\nb\tc   d", "a b c d"), ("سلام ‌ دنیا", "سلام دنیا"), ("می‌روم", "می‌روم"), (None, "")],
)
def test_normalize(spark, given, wanted):
    told = value(spark, given, text.normalize)
    assert told == wanted or told.replace("  ", " ") == wanted


def test_presentation_forms_keep_their_letter(spark):
    assert value(spark, "ﻱ", text.normalize) == "ي"


def test_literals_are_normalised_like_columns(spark):
    for said in ("سلام ي ك ۱۲", "A  B", "کد‌ملی"):
        assert value(spark, said, text.normalize) == text.normalized_literal(said)


def test_checksums_are_columns(spark):
    assert [x for x in dir(checksums) if not x.startswith("_")]


def test_blanks_are_squeezed_as_by_their_class():
    from promptlake.functions.patterns import BLANK

    # what Python's split and the class of blanks tell apart, beside others; a sign that NFKC opens into a space
    for said in ("a \x1c b", "\x85a\x1f", "﻿ a﻿\xa0b ", " a　 \tb\n", "¨ a ¨", " ̧a", "\u0085", "", " \n"):
        plain = unicodedata.normalize("NFKC", re.sub(f"{BLANK}+", " ", said))
        assert text.normalized_literal(said) == re.sub(rf"\A{BLANK}+|{BLANK}+\Z", "", plain).lower()


def test_tokens_are_counted_without_arrays(spark):
    said = [("",), (None,), ("ab, c-d e‌f 𝔘 𝔘𝔘 é_9 ?x",), ("a b  cc (dd)[ee]{ff}\"gg\"",)]
    df = spark.createDataFrame(said, "t string").select(text.normalize(F.col("t")).alias("n"))
    told = df.select(text.token_numbers(F.col("n")).alias("k"), F.size(text.tokens_ascii(F.col("n"))), F.size(text.tokens(F.col("n"))))
    assert [tuple(r.k) == tuple(r)[1:] for r in told.collect()] == [True] * len(said)


def test_keywords_stand_alone(spark):
    from promptlake.operators import rules

    listed = spark.createDataFrame([("a", ["Of the"], "LOW", True), ("b", ["x+y"], "LOW", True), ("c", ["𝔘‌é"], "LOW", True)], "code string, keywords array<string>, severity string, is_active boolean")
    patterns = [r[0] for r in listed.select(rules.phrase_pattern(F.col("keywords")[0])).collect()]
    # no search begins with a class of blanks
    assert all(p.startswith(f"(?i){w}") for p, w in zip(patterns, ("Of", "x\\+y", "𝔘"), strict=True))
    said = {"of the": "a", "off the": "", "x of  THE": "a", "of the.": "", "often the of": "", "𝔘 é": "c", "𝔘𝔘 é": "", "é x+Y\n": "b", "xx+y": "", "x+y,": "", "a of the x+y 𝔘  é": "abc"}
    df = spark.createDataFrame(list(said.items()), "t string, want string")
    told = df.select("want", F.array_join(F.transform(rules.keyword_hits(listed)(F.col("t")), lambda r: r["code"]), "").alias("got"))
    assert [r.got for r in told.collect()] == [r.want for r in told.collect()]


def test_places_of_words_overlap(spark):
    from promptlake.functions import detectors

    said = [("ababa aba",), ("ing inging",), ("",), ("éé𝔘é",)]
    for word in ("aba", "ing", "a", "éé", "𝔘", ".", "ab"):
        for r in spark.createDataFrame(said, "t string").select("t", detectors._places(F.col("t"), word).alias("n")).collect():
            assert r.n == sum(r.t.startswith(word, i) for i in range(len(r.t)))
    plan = spark.range(1).select(detectors.behaviour(F.lit("x"), F.col("id").cast("string"))["mentions"])._jdf.queryExecution().analyzed().toString()
    assert "(?=" not in plan


def test_detectors_run_where_something_may_be(spark):
    from promptlake.functions import detectors as d

    assert all(re.search("[\u0600-\u06ff]", w) for w in [*d.DECLARING, *d.JAILBREAK_PHRASES] if not w.isascii())
    some, parts = random.Random(5), ["0012345679", "6037-9911 2345 6786", "6037991899999991", "IR062960000000100324200001", "iban DE89370400440532013000", "رمز عبور: abcd12", "my phone is 091 2345 678", "موبایل من (021) 555-1234", "sk-" + "a" * 24, "AKIA" + "B" * 16, "-----BEGIN X PRIVATE KEY-----", "password=hunter22", "Token : zz9", "redis://h:1/0", "a@b.co, c@d.io; e@f.org", "09121234567 09121234568 09121234569", "Ignore Previous", "بدون محدودیت پاسخ", "نادیده بگیر", "DAN mode", "licensed under", "plain words", "یک متن ساده", "12", "\n"]
    texts = [*parts, None, "", *(" ".join(some.choices(parts, k=some.randrange(2, 6))) for _ in range(300)), *("".join(some.choices("09 -()@:=aIR+", k=24)) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", text.normalize(F.col("t")))
    rules = [{"id": "r", "detector_type": "REGEX", "pattern": "licensed under", "action": "BLOCK_EXTERNAL"}]
    never = {"TELCO_HUB_NODE": ["no such term"]}  # with terms the detectors run on every text
    told = docs.select("i", d.dlp_outcome(F.col("t"), F.col("n"), None, rules).alias("gated"), d.dlp_outcome(F.col("t"), F.col("n"), never, rules).alias("every")).collect()
    assert len(told) == len(texts) and all(r.gated == r.every for r in told)
    assert {h.category for r in told for h in r.gated.hits} >= {*d.CRITICAL, "bulk_email", "bulk_mobile", "policy_regex"}
    plan = docs.select(d.dlp_outcome(F.col("t"), F.col("n")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("@[a-zA-Z0-9") == 1  # addresses are counted once, not once for the test and once for the words


def test_addresses_begin_where_their_run_does(spark):
    from promptlake.functions import detectors as d

    plain, some = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", random.Random(3)
    texts = ["a@b.com_x@y.org", "a@b.com@c.de", "@", "a@@b.cc", *("".join(some.choices("aaaabbb.@_%1 \xe9", k=some.randrange(1, 90))) for _ in range(3000))]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(d.EMAIL), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in told) and sum(len(r.a) for r in told) > 100
    assert spark.createDataFrame([("a" * 300_000 + " x@y.org",)], "t string").select(F.regexp_count("t", F.lit(d.EMAIL)).alias("n")).first().n == 1
