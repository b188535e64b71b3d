"""Small chunks and units of whole tables against plain Python."""

import re
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from promptlake.operators import ingestion

DOCS = "/root/testdata/sf0.01/documents.parquet"


def packed(parts, joiner, smallest=100, largest=800, overlap=50):
    out, buffer = [], ""
    for part in parts:
        if not buffer:
            buffer = part
        elif len(buffer) + len(part) + 1 <= largest:
            buffer += joiner + part
        elif len(buffer) >= smallest:
            out.append(buffer)
            buffer = buffer[-overlap:] + " " + part
        else:
            buffer += " " + part
    return out + [buffer.strip()] if buffer.strip() else out


def small(text):
    cut = lambda t: [s for s in re.split(r"(?<=[.٬؟!])\s*", t) if s.strip()]
    segments = []
    for p in re.split(r"\n\n+", text or ""):
        if p.strip():
            segments += cut(p) if len(p) > 800 else [p]
    out = []
    for c in packed([s.strip() for s in segments], "\n"):
        out += [x.strip() for x in packed(cut(c), " ")] if len(c) > 800 else [c]
    return out


def test_small_chunks_of_all_documents(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: [c.content for c in r.c] for r in docs.select("doc_id", ingestion.small_chunks(F.col("text")).alias("c")).collect()}
    t = pq.read_table(DOCS)
    wanted = {i: small(x) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)}
    assert got == wanted and sum(map(len, got.values())) > 2000
    # the paragraph joints of real policies, a long sentence, and nothing
    made = ["a" * 90 + "\n\n" + "b" * 790 + "\n\n\nc.", "x" * 2000, "One. " * 400, None, "", " \n\n ", "short\n\n" * 50 + "محرمانه"]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    told = {r.i: r.c for r in df.select("i", ingestion.small_chunks(F.col("t")).alias("c")).collect()}
    assert {i: [c.content for c in c_] for i, c_ in told.items()} == {i: small(x) for i, x in enumerate(made)}
    assert [c.is_restricted for c in told[6]][-1] and not any(c.is_restricted for c in told[2])


def test_units_hold_every_line_in_order(spark):
    """Each unit is a run of lines; all lines of a page come out once, in order, long units cut between sentences."""
    pages = spark.read.parquet(DOCS).select("doc_id", F.lit(1).alias("page"), "text")
    rows = ingestion.units(pages, "doc_id").collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    t = pq.read_table(DOCS)
    squeezed = lambda s: re.sub(r"\s+", " ", s).strip()
    checked = 0
    for i, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        own = sorted(by_doc[i], key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        assert squeezed(" ".join(r.text for r in own)) == squeezed(" ".join(lines))
        title, at = None, 0
        for r in own:
            title = r.text if r.unit_type == "HEADING" else title
            assert r.section_title == title
            assert (r.span_start, r.span_end) == (at, at + len(r.text))
            at += len(r.text) + 1
            if r.unit_type == "HEADING":
                assert len(r.text) <= 120 and r.text in lines
            if r.unit_type in ("CLAUSE", "PARAGRAPH") and len(r.text) > 1200:
                assert len([s for s in re.split(r"(?<=[.!؟؛?\n])\s+", r.text) if s]) == 1, "only a single sentence may be longer"
        checked += len(own)
    assert checked > 2000
