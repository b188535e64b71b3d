"""Queries over scores, stored tables, logs and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.functions.vectors import hashed_words
from promptlake.operators import evaluation, rules, scoring, store
from promptlake.operators.numbering import numbered, placed
from promptlake.sources.readers import spread, table
from promptlake.streaming import logs

NOON = "2024-01-15 12:00:00"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_benchmark(spark, sf_dir):
    """Documents as queries against the benchmark's texts, the bounded corpus of restricted chunks."""
    queries = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"))
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    return scoring.bm25(queries, chunks).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def similar_chunks(spark, sf_dir):
    queries = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"))
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    return scoring.similar_chunks(queries, chunks, 20.0).select("query_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), "score")


def _concepts(spark, sf_dir):
    """The policy's bounded index: the mean vector of each label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = e.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector")).withColumnRenamed("label", "id")


def cosine_topk(spark, sf_dir):
    """Every vector's nearest concepts (label means)."""
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    top = scoring.dense_top_blocks(queries, _concepts(spark, sf_dir), k=3, minimum=-1.0)
    return top.select("query_id", F.col("id").cast("bigint").alias("id"), F.round("dense_score", 6).alias("score"), F.col("dense_rank").cast("bigint").alias("rank"))


def _ranks(spark, sf_dir):
    """All benchmark items as queries: dense ranks over hashed words of the items, lexical ranks by BM25."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    told = items.withColumn("vector", hashed_words(F.col("text"), 32))
    queries = told.select(F.col("item_id").alias("query_id"), "text", "vector")
    dense = scoring.dense_top_blocks(queries, told.select(F.col("item_id").alias("id"), "vector"), k=10, minimum=0.0)
    lexical = scoring.bm25(queries, told.select(F.col("item_id").alias("id"), "text"), chunk_key="id")
    return queries, told, dense, scoring.lexical_ranks(lexical)


def rrf_fusion(spark, sf_dir):
    _, _, dense, lexical = _ranks(spark, sf_dir)
    fused = scoring.fused(dense, lexical)
    return fused.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("dense_score", 6).alias("dense_score"), F.round("lexical_score", 5).alias("lexical_score"), F.round("rrf_score", 8).alias("rrf_score"))


def mandatory_inclusion(spark, sf_dir):
    queries, told, dense, lexical = _ranks(spark, sf_dir)
    must = told.where("item_id < 3").select(F.col("item_id").alias("id"))
    out = scoring.with_mandatory(scoring.fused(dense, lexical), queries, must)
    return out.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank").isNull()).alias("n_added"))


def index_health(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("vector"))
    return scoring.index_health(index, 64)


def retrieval_metrics(spark, sf_dir):
    ranked = cosine_topk(spark, sf_dir)
    expected = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("id"))
    m = evaluation.retrieval_metrics(ranked, expected, at=(1, 3))
    return m.select("n_queries", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


def _judged(spark, sf_dir):
    """Every labelled text: those with exclamations as the sensitive class, against the labels of quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    n = F.regexp_count("text", F.lit("!!|###|\\*\\*\\*"))
    score = F.least(F.lit(1.0), n / 20.0)
    return docs.select("doc_id", F.when(F.col("quality") == 0, "SENSITIVE").otherwise("SAFE").alias("expected"), score.alias("score"))


def classifier_metrics(spark, sf_dir):
    actual = F.when(F.col("score") >= 0.85, "SENSITIVE").when(F.col("score") >= 0.5, "UNCERTAIN").otherwise("SAFE")
    m = evaluation.classifier_metrics(_judged(spark, sf_dir).withColumn("actual", actual))
    return m.select(*(F.round(c, 9).alias(c) if d == "double" else F.col(c) for c, d in m.dtypes))


def calibration_grid(spark, sf_dir):
    m = evaluation.calibration_grid(_judged(spark, sf_dir), [0.6, 0.7, 0.85, 0.95], [0.3, 0.5, 0.55])
    return m.select("sensitive_from", "noise_below", "n", F.round("accuracy", 9).alias("accuracy"), F.round("sensitive_recall", 9).alias("sensitive_recall"), "accepted")


def end_to_end_metrics(spark, sf_dir):
    told = _judged(spark, sf_dir).select(
        F.when(F.col("expected") == "SAFE", "EXTERNAL").when(F.col("doc_id") % 5 == 0, "BLOCKED").otherwise("LOCAL").alias("expected"), F.when(F.col("score") >= 0.5, "LOCAL").otherwise("EXTERNAL_DIRECT").alias("route")
    )
    m = evaluation.end_to_end_metrics(told)
    return m.select(*(F.round(c, 9).alias(c) if d == "double" else F.col(c) for c, d in m.dtypes))


def p95_nearest(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "value", 0.95)


def p95_by_type(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "value", 0.95, ["event_type"])


def conflict_pairs(spark, sf_dir):
    """Suppliers' nations as rules: two words of the name are keywords, the balance decides the action."""
    s = table(spark, sf_dir, "supplier")
    action = F.when(F.col("s_acctbal") > 6000, "BLOCK_EXTERNAL").when(F.col("s_acctbal") > 2000, "MASK").otherwise("FLAG_REVIEW")
    told = s.select(
        F.col("s_suppkey").alias("ordinal"),
        action.alias("action"),
        F.sha2(F.col("s_suppkey").cast("string"), 256).alias("identity_hash"),
        F.array(F.concat(F.lit("N"), (F.col("s_suppkey") % 17).cast("string")), F.concat(F.lit("k"), (F.col("s_suppkey") % 31).cast("string"))).alias("keywords"),
    )
    return rules.conflicts(told)


def rule_codes(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select(F.concat(F.lit("R-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("code"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return store.with_codes(new, r, "id")


def row_numbers(spark, sf_dir):
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("row_no").cast("bigint").alias("row_no"))


def nested_concepts(spark, sf_dir):
    """Orders with their lines nested, as concepts with their examples are."""
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")
    out = store.nested(parents, {"lines": (lines, "l_linenumber")}, "key")
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return out.select("key", F.size("lines").cast("bigint").alias("n_lines"), F.round(total, 4).alias("quantity"))


def active_semi(spark, sf_dir):
    concepts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("DRAFT").alias("review_status"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") > 5000, "ACTIVE").otherwise("DRAFT").alias("status"))
    return store.active_concepts(concepts, documents).select("id", "document_id")


def delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    one = lambda t: t.groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("m")).select("o_custkey", "m.*")
    return store.upserted(one(old), one(new), ["o_custkey"], "o_orderkey")


def status_counts(spark, sf_dir):
    return evaluation.status_counts(table(spark, sf_dir, "orders"), ["F", "O", "P"], ["o_orderpriority"], "o_orderstatus")


def duplicate_keys(spark, sf_dir):
    return store.duplicate_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


def log_page(spark, sf_dir):
    """One page of the log: a limit is what paging is."""
    log = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    page = store.log_page(log, 3, 20, newest="ts", tie="event_id", event_type="click")
    return page.select("event_id", "event_type", "user_id")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("error", "purchase"), "BLOCK").otherwise("ALLOW").alias("action"), F.col("ts").alias("created_at"))


def log_stats(spark, sf_dir):
    return evaluation.decision_stats(_log(spark, sf_dir), F.lit(NOON).cast("timestamp"))


def log_daily(spark, sf_dir):
    return logs.daily_stats(_log(spark, sf_dir)).select(F.col("day").cast("date").alias("day"), "total", "blocked", "allowed")


def risk_first_order(spark, sf_dir):
    """Each document's place by the riskiest-first order within its source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    l_ = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    told = d.join(l_, "doc_id", "left")
    flags = F.coalesce(F.col("toxic"), F.lit(0)) + F.when(F.col("quality") == 0, 1).otherwise(0)
    told = told.select("doc_id", "source", "n_chars", (-flags).alias("flags"), F.coalesce(F.col("quality").cast("double"), F.lit(0.8)).alias("confidence"))
    return placed(told, "source", ["flags", "confidence"], "n_chars", "doc_id").select("doc_id", "source", F.col("place").cast("bigint").alias("place"))


def login_limiter(spark, sf_dir):
    told = logs.limited(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), window=86_400, most=2)
    return told.select("event_id", F.col("attempt_no").cast("bigint").alias("attempt_no"), "blocked")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_benchmark,
        similar_chunks,
        cosine_topk,
        rrf_fusion,
        mandatory_inclusion,
        index_health,
        retrieval_metrics,
        classifier_metrics,
        calibration_grid,
        end_to_end_metrics,
        p95_nearest,
        p95_by_type,
        conflict_pairs,
        rule_codes,
        row_numbers,
        nested_concepts,
        active_semi,
        delete_anti,
        upsert_latest,
        status_counts,
        duplicate_keys,
        log_page,
        log_stats,
        log_daily,
        risk_first_order,
        login_limiter,
    )
}

_BM25 = """
WITH {queries}, {chunks},
c AS (SELECT cid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9A-Za-z_\\x{{200C}}]+'), lambda x: x <> '') AS w FROM ch),
tot AS (SELECT count(*) AS n, avg(len(w)) AS a FROM c),
tf AS (SELECT cid, term, count(*) AS tf, any_value(l) AS l FROM (SELECT cid, len(w) AS l, unnest(w) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9A-Za-z_\\x{{200C}}]+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
s AS (SELECT qid, cid, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), tot GROUP BY ALL)
"""
_DOCS_ITEMS = {"queries": "q AS (SELECT doc_id AS qid, text FROM documents)", "chunks": "ch AS (SELECT item_id AS cid, text FROM benchmark)"}

_COSINE = """
WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT vec_id AS query_id, CAST(label_c AS BIGINT) AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score, e.label AS own FROM embeddings e, (SELECT label AS label_c, v FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""
_JUDGED = """
WITH j AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'SENSITIVE' ELSE 'SAFE' END AS expected, least(1.0::DOUBLE, len(regexp_extract_all(text, '!!|###|\\*\\*\\*')) / 20.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id)),
a AS (SELECT *, CASE WHEN score >= 0.85 THEN 'SENSITIVE' WHEN score >= 0.5 THEN 'UNCERTAIN' ELSE 'SAFE' END AS actual FROM j)
"""

ORACLE_SQL = {
    "bm25_benchmark": _BM25.format(**_DOCS_ITEMS) + "SELECT qid AS query_id, cid AS chunk_id, round(score, 5) AS score FROM s",
    "similar_chunks": _BM25.format(**_DOCS_ITEMS)
    + ", b AS (SELECT qid, count(*) AS n, least(max(score), 1.0) AS score FROM s WHERE score > 20.0 GROUP BY qid) SELECT qid AS query_id, coalesce(n, 0) AS n_chunks, coalesce(b.score, 0.0)::DOUBLE AS score FROM q LEFT JOIN b USING (qid)",
    "cosine_topk": _COSINE + "SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 3",
    "index_health": "SELECT count(*) AS n, count_if(NOT ok) AS n_bad, count(*) > 0 AND count_if(NOT ok) = 0 AS healthy FROM (SELECT coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings)",
    "retrieval_metrics": _COSINE
    + "SELECT count(*) AS n_queries, round(count_if(f <= 1) / count(*), 9) AS recall_at_1, round(count_if(f <= 3) / count(*), 9) AS recall_at_3, round(avg(coalesce(1.0 / f, 0.0)), 9) AS mrr FROM (SELECT query_id, min(rank) FILTER (id = own AND rank <= 3) AS f FROM r GROUP BY query_id)",
    "classifier_metrics": _JUDGED
    + """, n AS (SELECT count(*) AS n, count_if(expected = actual) AS r, count_if(expected = 'SENSITIVE' AND actual = 'SENSITIVE') AS tp, count_if(expected = 'SAFE' AND actual = 'SENSITIVE') AS fp,
  count_if(expected = 'SAFE' AND actual = 'SAFE') AS tn, count_if(expected = 'SENSITIVE') AS s, count_if(expected = 'SAFE') AS f, count_if(actual = 'UNCERTAIN') AS u FROM a)
SELECT n, round(r / n, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS sensitive_precision, round(coalesce(tp / nullif(s, 0), 0), 9) AS sensitive_recall,
  round(coalesce(2.0 * tp / nullif(tp + fp + s, 0), 0), 9)::DOUBLE AS sensitive_f1, round(coalesce(tn / nullif(f, 0), 0), 9) AS safe_accuracy, u AS n_undecided FROM n""",
    "calibration_grid": _JUDGED
    + """, g AS (SELECT c AS sensitive_from, x AS noise_below FROM (VALUES (0.6::DOUBLE), (0.7), (0.85), (0.95)) AS a(c), (VALUES (0.3::DOUBLE), (0.5), (0.55)) AS b(x)),
t AS (SELECT sensitive_from, noise_below, expected, CASE WHEN score < noise_below THEN 'SAFE' WHEN score >= sensitive_from THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS actual FROM j, g),
m AS (SELECT sensitive_from, noise_below, count(*) AS n, count_if(expected = actual) / count(*) AS accuracy, coalesce(count_if(expected = 'SENSITIVE' AND actual = 'SENSITIVE') / nullif(count_if(expected = 'SENSITIVE'), 0), 0) AS r FROM t GROUP BY ALL)
SELECT sensitive_from, noise_below, n, round(accuracy, 9) AS accuracy, round(r, 9) AS sensitive_recall, r >= 0.9 AND accuracy >= 0.85 AS accepted FROM m""",
    "end_to_end_metrics": _JUDGED
    + """, e AS (SELECT expected = 'SAFE' AS open, score < 0.5 AS out, expected <> 'SAFE' AND doc_id % 5 = 0 AS blocked FROM j)
SELECT count(*) AS n, count_if(open = out) AS n_right, round(count_if(open = out) / count(*), 9) AS accuracy, round(coalesce(count_if(NOT open AND NOT out) / nullif(count_if(NOT open), 0), 0), 9) AS sensitive_recall,
  round(coalesce(count_if(open AND out) / nullif(count_if(open), 0), 0), 9) AS safe_accuracy, count_if(blocked AND out) AS critical_misses FROM e""",
    "p95_nearest": "SELECT l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS value, len(l) AS n FROM (SELECT list(value ORDER BY value) AS l FROM events WHERE value IS NOT NULL)",
    "p95_by_type": "SELECT event_type, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS value, len(l) AS n FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    "conflict_pairs": """
WITH r AS (SELECT s_suppkey AS o, CASE WHEN s_acctbal > 6000 THEN 'BLOCK_EXTERNAL' WHEN s_acctbal > 2000 THEN 'MASK' ELSE 'FLAG_REVIEW' END AS a, sha256(CAST(s_suppkey AS VARCHAR)) AS h, s_suppkey % 17 AS k1, s_suppkey % 31 AS k2 FROM supplier),
p AS (SELECT x.o AS i, y.o AS j, sha256(x.h || '~' || y.h)[1:16] AS g FROM r x JOIN r y ON x.o < y.o AND x.a <> y.a AND (x.k1 = y.k1 OR x.k2 = y.k2)),
e AS (SELECT i AS ordinal, i, j, g FROM p UNION ALL SELECT j, i, j, g FROM p)
SELECT ordinal, arg_max(g, i * 100000000 + j) AS conflict_group FROM e GROUP BY ordinal""",
    "rule_codes": "WITH m AS (SELECT max(n_nationkey) AS m FROM nation) SELECT s_suppkey AS id, 'R-' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS code FROM (SELECT s_suppkey, CAST(m + row_number() OVER (ORDER BY s_suppkey) AS VARCHAR) AS n FROM supplier, m)",
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders",
    "nested_concepts": "SELECT o_orderkey AS key, count(l_orderkey) AS n_lines, round(coalesce(sum(l_quantity), 0), 4)::DOUBLE AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "active_semi": "SELECT o_orderkey AS id, o_custkey AS document_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "delete_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND c_custkey = o_custkey)",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) = 1",
    "status_counts": "SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    "duplicate_keys": "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "log_page": "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
    "log_stats": f"SELECT count(*) AS total, count_if(event_type IN ('error', 'purchase')) AS blocked, count_if(event_type NOT IN ('error', 'purchase')) AS allowed, count_if(date_trunc('day', ts) = TIMESTAMP '{NOON[:10]} 00:00:00') AS today FROM events",
    "log_daily": "SELECT CAST(ts AS DATE) AS day, count(*) AS total, count_if(event_type IN ('error', 'purchase')) AS blocked, count_if(event_type NOT IN ('error', 'purchase')) AS allowed FROM events GROUP BY 1",
    "risk_first_order": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(toxic, 0) + CASE WHEN quality = 0 THEN 1 ELSE 0 END DESC, coalesce(CAST(quality AS DOUBLE), 0.8), n_chars DESC, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)",
    "login_limiter": """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, s, k, s AS opened, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.s, e.k, CASE WHEN e.s > w.opened + 86400 THEN e.s ELSE w.opened END, CASE WHEN e.s > w.opened + 86400 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, CAST(n AS BIGINT) AS attempt_no, n > 2 AS blocked FROM w""",
}

