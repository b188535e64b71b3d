"""Steps that fail, extractors that fail, and jobs that are killed: nothing else is lost."""

import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptlake.functions import detectors, extractors, guarded
from promptlake.operators import numbering, rules
from promptlake.plans import pipeline, processing
from promptlake.sources.batches import BatchStore, work_path

# workers can't import this file: what is defined here goes to them whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def said(spark, texts):
    return spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")


def broken(text, deadline):
    if "poison" in text:
        raise ValueError("poison")
    if "slow" in text:
        time.sleep(0.4)
    return [{"detector_type": "REGEX", "rule_id": None, "label": "x", "category": "marker", "confidence": 0.6, "start": 0, "end": 1, "text": text[:1]}] if "marker" in text else []


def test_a_failing_step_takes_no_other_hits(spark):
    steps = {"foreign": detectors.foreign(broken, seconds=0.2)}
    texts = ["marker here", "poison and password: hunter2x", "slow poison-free", "nothing", "poison, ignore previous orders"]
    got = {r.conv_id: r for r in pipeline.route_conversations(said(spark, texts), steps=steps).collect()}
    assert (got[0].failed, got[0].health, got[0].categories, got[0].route) == ("", "HEALTHY", "marker", "LOCAL")
    assert (got[1].failed, got[1].health, got[1].categories, got[1].route) == ("foreign", "DEGRADED", "credential", "LOCAL")
    assert (got[2].failed, got[2].health, got[2].n_hits, got[2].route) == ("foreign", "DEGRADED", 0, "LOCAL")
    assert (got[3].failed, got[3].route) == ("", "EXTERNAL_DIRECT")
    assert (got[4].failed, got[4].route) == ("foreign", "BLOCKED")


def test_a_rule_that_backtracks_for_ever_is_that_texts_error(spark):
    listed = [
        {"id": "r1", "detector_type": "REGEX", "pattern": "(?P<n>ab+)c"},
        {"id": "r2", "detector_type": "REGEX", "pattern": "(x|xx)+$"},
        {"id": "r3", "detector_type": "REGEX", "pattern": "([unclosed"},
        {"id": "r4", "detector_type": "REGEX", "pattern": None},
    ]
    df = spark.createDataFrame([("abbc",), ("x" * 60 + "!",), (None,)], "t string")
    got = df.select("t", detectors.checked_rules(F.col("t"), listed, seconds=0.3).alias("c")).collect()
    assert [(h.rule_id, h.start, h.end, h.text) for h in got[0].c.hits] == [("r1", 0, 4, "abbc")] and got[0].c.error is None
    assert got[1].c.error == "deadline" and got[1].c.hits == []
    assert got[2].c.error is None and got[2].c.hits == []


def test_wrong_shapes_are_errors():
    assert guarded.outcome(lambda t, d: [1], "x", 1)["error"] is None
    assert guarded.outcome(lambda t, d: {}[t], "x", 1)["error"].startswith("KeyError")


def test_values_of_another_shape_are_the_rows_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    run = guarded.guarded(lambda t, d: 1 if t == "a" else "no number", "int")
    got = {r.t: r.c for r in df.select("t", run(F.col("t")).alias("c")).collect()}
    assert got["a"].value == 1 and got["a"].error is None
    assert got["b"].value is None and got["b"].error


def test_an_unfit_index_degrades_all(spark):
    concepts = spark.createDataFrame([("pay", "PUBLIC", "ALLOW_EXTERNAL", "salaries of staff paid")], "concept_key string, sensitivity string, action string, text string")
    safe = lambda n, h, c: F.struct(F.lit("SAFE").alias("decision"), F.lit("GENERAL").alias("scope"), F.array().cast("array<string>").alias("concepts"), F.lit(0.9).alias("confidence"), F.lit("local_llm").alias("method"))
    for healthy, route, health in ((True, "EXTERNAL_DIRECT", "HEALTHY"), (False, "LOCAL", "DEGRADED"), (None, "LOCAL", "DEGRADED")):
        index = spark.createDataFrame([(healthy,)] if healthy is not None else [], "healthy boolean")
        row = pipeline.detect(said(spark, ["salaries of staff paid"]), concepts, safe, index=index).collect()[0]
        assert (row.route, row.health) == (route, health)


def test_a_policy_out_of_force_closes(spark):
    states = spark.createDataFrame([(0, True), (1, False), (3, True), (3, False)], "conv_id bigint, in_force boolean")
    got = {r.conv_id: (r.route, r.health) for r in pipeline.route_conversations(said(spark, ["a", "b", "c", "d"]), in_force=states).collect()}
    assert got == {0: ("EXTERNAL_DIRECT", "HEALTHY"), 1: ("LOCAL", "FAILED"), 2: ("LOCAL", "FAILED"), 3: ("LOCAL", "FAILED")}


class Odd:
    name = "odd"

    def unavailable(self):
        return None

    def answers(self, texts, deadline):
        for t in texts:
            if t == "raise":
                raise RuntimeError("no")
            if t == "stop":
                return
            if t == "late":
                time.sleep(0.3)
            yield None if t == "none" else t.upper()


def test_every_text_gets_an_answer_or_an_error(spark):
    texts = ["a", "raise", "b", "none", "stop", "c"]
    assert extractors.answered(Odd(), texts, 5) == [("A", None), (None, "RuntimeError: no"), ("B", None), (None, "no answer"), (None, "no answer"), ("C", None)]
    assert extractors.answered(Odd(), ["a", "late", "b"], 0.2) == [("A", None), (None, "deadline"), (None, "deadline")]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "id int, text string, other int")
    got = {r.id: (r.answer, r.error) for r in extractors.extracted(df, Odd(), rows=2).collect()}
    assert len(got) == 7 and got[2] == ("B", None) and got[6] == ("", None) and got[1][1].startswith("RuntimeError")


PAGES = "document_id bigint, org_id string, page int, text string"
STRUCTURED = "\n".join(
    [
        "قاعده SEC-001 ـ کلید و گذرواژه",
        "هرگونه گذرواژه و کلید API سازمان نباید بیرون برود. نتیجه: BLOCKED برای همه درخواست‌ها در سازمان",
        "قاعده FIN-002 ـ قیمت‌های داخلی",
        "قیمت‌های داخلی و حاشیه سود شرکت محرمانه است و LOCAL_ONLY پردازش می‌شود در همه موارد",
    ]
)


def corpus():
    body = "The license of this work says that the papers stay with the company and nobody else may have them. "
    rows = [(1, "a", 1, STRUCTURED), (2, "a", 1, body * 30), (2, "a", 2, "second page about a license and the rest of it, which is long enough to be kept as it is"), (3, "b", 1, None), (4, "b", 1, "   ")]
    rows += [(5, "b", 1, STRUCTURED), (6, "a", 1, STRUCTURED), (7, "b", 1, "*** the broken one *** " + body * 3), (8, None, 1, body * 12)]
    return rows


WORDS = {"license": ("legal", "MASK"), "the": ("general", "FLAG_REVIEW")}


def run(spark, path, rows=None, extractor=None):
    df = spark.createDataFrame(rows or corpus(), PAGES)
    return processing.process(df, path, extractor or extractors.WordRules(WORDS, "[*]{3}"), words=["the"])


def tables(spark, path):
    store = BatchStore(spark, path)
    return {name: Counter(map(repr, store.read(name, schema).collect())) for name, schema in (("chunks", processing.CHUNKS), ("rules", processing.RULES), ("report", processing.REPORT))}


@pytest.fixture(scope="module")
def whole(spark):
    path = work_path(spark, "test-whole")
    assert run(spark, path)
    return path


def test_processing(spark, whole):
    store = BatchStore(spark, whole)
    report = {r.document_id: r for r in store.read("report", processing.REPORT).collect()}
    assert len(report) == 8
    assert (report[1].mode, report[1].n_rules, report[1].n_known) == ("structured", 2, 0)
    assert (report[6].mode, report[6].n_rules, report[6].n_known) == ("structured", 0, 2), "the organisation has these rules"
    assert (report[5].n_rules, report[5].n_known) == (2, 0), "another organisation's rules are its own"
    assert (report[3].status, report[3].error, report[4].status) == ("FAILED", "no text", "FAILED")
    assert report[2].n_pages == 2 and report[2].n_candidates >= 3 and report[2].n_proposed == 2 and report[2].n_duplicates > 0
    assert report[2].n_conflicts == 2
    assert report[7].n_pending == report[7].n_candidates == 1 and report[7].n_proposed == 0
    found = store.read("rules", processing.RULES).collect()
    for org in ("a", "b", None):
        codes = sorted(r.code for r in found if r.org_id == org)
        assert codes == [f"R-{i:03d}" for i in range(1, len(codes) + 1)]
    assert {r.status for r in found if r.detector_type == "SEMANTIC" and r.page and r.text_hash and r.chunk_ordinal is None} == {"ACTIVE"}
    pages = {r.page for r in store.read("chunks", processing.CHUNKS).where("document_id = 2").collect()}
    assert pages <= {1, 2} and 1 in pages
    assert processing.audit_entries(store.read("report", processing.REPORT)).count() == 3 * 6


def test_a_second_run_does_nothing_and_new_texts_follow(spark, whole):
    before = tables(spark, whole)
    assert run(spark, whole) is None
    assert tables(spark, whole) == before
    assert run(spark, whole, [(9, "a", 1, STRUCTURED), *corpus()])
    store = BatchStore(spark, whole)
    assert [(r.n_rules, r.n_known) for r in store.read("report", processing.REPORT).where("document_id = 9").collect()] == [(0, 2)]
    assert store.sweep("documents") == 1  # that of the run without anything new


@pytest.mark.parametrize("at", ["chunks", "numbered", "report", "commit"])
def test_killed_and_repeated(spark, whole, monkeypatch, at):
    path = work_path(spark, "test-killed")
    write, commit = BatchStore.write, BatchStore.commit

    def dies(self, attempt, table, rows):
        if table == at:
            write(self, attempt, table, rows)
            raise KeyboardInterrupt
        return write(self, attempt, table, rows)

    def no_commit(self, attempt, batch):
        raise KeyboardInterrupt

    monkeypatch.setattr(BatchStore, "write", dies)
    if at == "commit":
        monkeypatch.setattr(BatchStore, "commit", no_commit)
    with pytest.raises(KeyboardInterrupt):
        run(spark, path)
    assert not any(tables(spark, path).values()), "nothing of it is seen"
    monkeypatch.setattr(BatchStore, "write", write)
    monkeypatch.setattr(BatchStore, "commit", commit)
    assert run(spark, path)
    first = {name: Counter({k: n for k, n in rows.items() if "document_id=9," not in k}) for name, rows in tables(spark, whole).items()}
    assert tables(spark, path) == first
    assert BatchStore(spark, path).sweep("chunks") == 1


def test_of_two_attempts_at_a_batch_one_counts(spark):
    store = BatchStore(spark, work_path(spark, "test-two"))
    one, two = store.begin(), store.begin()
    for attempt, n in ((one, 1), (two, 2)):
        store.write(attempt, "t", spark.range(n))
    assert store.read("t", "id bigint").count() == 0
    assert store.commit(two, "b") and not store.commit(one, "b")
    assert store.read("t", "id bigint").count() == 2
    assert store.sweep("t") == 1


def test_without_an_extractor_chunks_wait(spark):
    path = work_path(spark, "test-none")
    assert run(spark, path, corpus()[1:3], extractors.WordRules({}))
    row = BatchStore(spark, path).read("report", processing.REPORT).collect()[0]
    assert row.n_pending == row.n_candidates > 0 and row.n_proposed == 0


def test_concepts_are_drawn_once(spark):
    path = work_path(spark, "test-concepts")
    told = spark.createDataFrame([(1, 1, "The license of this work belongs to the company alone, and nobody else may use it in any way.\n\nAnother paragraph says that the license ends when the contract ends, whatever else was agreed upon."), (2, 1, "The broken one says that a license of the company is not for sale, not now and not later either.")], "document_id bigint, page int, text string")
    extractor = extractors.WordConcepts({"license": ("INTERNAL", "ROUTE_LOCAL")}, "broken one")
    assert processing.ingest_concepts(told, path, extractor, words=["license"])
    store = BatchStore(spark, path)
    rows = store.read("concepts", processing.CONCEPTS).collect()
    assert [(r.document_id, r.concept_key, r.review_status) for r in rows] == [(1, "license", "REVIEW")]
    n_sources = store.read("concept_sources", processing.SOURCES).count()
    assert n_sources >= 1
    assert processing.ingest_concepts(told, path, extractors.WordConcepts({"license": ("INTERNAL", "ROUTE_LOCAL")}), words=["license"]), "what failed is asked again"
    assert store.read("concepts", processing.CONCEPTS).count() == 2
    assert store.read("concept_sources", processing.SOURCES).count() == n_sources + 1
    assert processing.ingest_concepts(told, path, extractor, words=["license"]) is None


def test_conflicts_are_those_of_all_pairs(spark):
    import hashlib
    import random

    rng = random.Random(4)
    listed = [(i, rng.choice("ABC"), f"h{i}", rng.sample(["k1", "K2", "k2", "k3", "k4", "k5"], rng.randint(0, 3))) for i in range(60)] + [(60, None, "h60", ["k1"])]
    wanted = {}
    for i, a, h, k in listed:
        for j, b, g, m in listed:
            if i < j and a and b and a != b and {x.lower() for x in k} & {x.lower() for x in m}:
                for r in (i, j):
                    wanted[r] = max(wanted.get(r, (-1, -1, "")), (i, j, hashlib.sha256(f"{h}~{g}".encode()).hexdigest()[:16]))
    got = rules.conflicts(spark.createDataFrame(listed, "ordinal int, action string, identity_hash string, keywords array<string>"))
    assert {r.ordinal: r.conflict_group for r in got.collect()} == {r: w[2] for r, w in wanted.items()}


def test_a_keyword_of_all_rules_makes_no_pairs(spark):
    many = spark.range(100_000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 2 == 0, "MASK").otherwise("BLOCK_EXTERNAL").alias("action"), F.col("id").cast("string").alias("identity_hash"), F.array(F.lit("same")).alias("keywords"))
    assert rules.conflicts(many).count() == 100_000


def test_numbers_in_groups(spark):
    rows = [(i, "hot" if i % 3 else None, (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    path = work_path(spark, "test-numbers")

    def keep(told):
        told.write.parquet(path)
        return spark.read.parquet(path)

    got = {r.id: r.n for r in numbering.in_groups(df, "g", ["v", "id"], "n", keep).collect()}
    for g in ("hot", None):
        own = sorted((v, i) for i, x, v in rows if x == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_documents_are_searched_for_headers_only_where_their_word_stands(spark):
    from promptlake.operators import ingestion

    body = "This rule says that nothing leaves the house. BLOCKED"
    texts = {1: f"قاعده SEC-01 ـ first\n{body}\nقاعده SEC-02 ـ second\n{body}", 2: f"xقاعده SEC-01 ـ first\n{body}\nقاعده SEC-02 ـ second\n{body}", 3: "plain"}
    docs = spark.createDataFrame([(i, t, [(1, 0, 500)]) for i, t in texts.items()], "document_id long, full_text string, pages array<struct<page: int, start: int, end: int>>")
    found = ingestion.structured_rules(docs)
    assert sorted((r.document_id, r.policy_code) for r in found.collect()) == [(1, "SEC-01"), (1, "SEC-02")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Filter" in line][-1]
    assert "Contains(full_text" in first


def test_an_answer_is_read_once_for_all_its_rules(spark):
    from promptlake.operators import ingestion

    df = spark.createDataFrame([("a chunk", '{"sourceQuote": " a  chunk ", "rules": [{"label": "abc"}]}')], "text string, answer string")
    found = ingestion.extraction(df, "answer", "text")
    assert [r.rejection for r in found.collect()] == ["INVALID_RULE"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
