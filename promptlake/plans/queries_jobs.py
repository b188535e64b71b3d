"""Queries of jobs with several outputs: documents processed, concepts drawn from their units."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.functions.extractors import WordConcepts, WordRules
from promptlake.operators import store, vector_index
from promptlake.plans import processing
from promptlake.plans.queries_text import WORDS, _N, boilerplate_sql, candidate_sql, chunks_sql
from promptlake.sources import logs
from promptlake.sources.batches import BatchStore, work_path
from promptlake.sources.readers import spread, table
from promptlake.streaming import logs as stream_logs

#: Words to (category, action), and to (sensitivity, action); texts with a run of marks break the extractor.
PROPOSED = {"license": ("legal", "MASK"), "the": ("general", "FLAG_REVIEW"), "schein": ("papers", "MASK")}
DRAWN = {"license": ("INTERNAL", "ROUTE_LOCAL"), "que": ("PUBLIC", "ALLOW_EXTERNAL"), "der": ("CONFIDENTIAL", "BLOCK")}
BROKEN = "[*]{3}"


def pages(spark, sf_dir):
    """Documents as policy documents of one page; their source stands for the organisation."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("org_id"), F.lit(1).alias("page"), "text")


def processed_documents(spark, sf_dir):
    """The report of one run over all documents, with an extractor that fails at some chunks."""
    path = work_path(spark, "processed")
    processing.process(pages(spark, sf_dir), path, WordRules(PROPOSED, BROKEN), words=WORDS)
    told = BatchStore(spark, path).read("report", processing.REPORT)
    return told.drop("org_id", "text_hash", "error")


def processed_rules(spark, sf_dir):
    """How many rules each organisation has after the run, and its highest code: codes follow one another."""
    path = work_path(spark, "processed")
    processing.process(pages(spark, sf_dir), path, WordRules(PROPOSED, BROKEN), words=WORDS)
    told = BatchStore(spark, path).read("rules", processing.RULES)
    number = F.regexp_extract("code", "([0-9]+)", 1).cast("bigint")
    return told.groupBy("org_id").agg(F.count("*").alias("n_rules"), F.count_distinct("code").alias("n_codes"), F.max(number).alias("highest"), F.count("conflict_group").alias("n_conflicts"))


def ingested_concepts(spark, sf_dir):
    """Concepts drawn from all documents' units in two runs: the second has only what the first failed at, and fails again."""
    path = work_path(spark, "concepts")
    told = pages(spark, sf_dir)
    for _ in range(2):
        processing.ingest_concepts(told, path, WordConcepts(DRAWN, BROKEN), words=WORDS)
    return processing.unit_report(path, spark)


def log_stream_daily(spark, sf_dir):
    """The log's daily totals by a stream: events come in as a stream, changed totals go out in update mode, the last of each day counts."""
    path = work_path(spark, "daily")
    kept = BatchStore(spark, f"{path}/store")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # times are UTC, whatever the session's zone
    at = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))") if schema["ts"].dataType.typeName() == "timestamp_ntz" else F.col("ts")
    action = F.when(F.col("event_type").isin("error", "purchase"), "BLOCK").otherwise("ALLOW")
    daily = stream_logs.daily_stats(events.select(at.alias("created_at"), action.alias("action")))
    running = daily.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(logs.latest_sink(kept, "daily")).start()
    running.awaitTermination()
    told = logs.latest(kept, "day timestamp, total bigint, blocked bigint, allowed bigint", "day")
    return told.withColumn("day", F.date_from_unix_date(F.floor(F.unix_micros("day") / 86_400_000_000).cast("int")))


def merged_customers(spark, sf_dir):
    """Customers merged by key: those with orders get their last one's price, those with a negative balance and none go."""
    path = work_path(spark, "customers")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    store.write_keyed(c, path, ["c_custkey"], 16)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).cast(c.schema["c_acctbal"].dataType).alias("c_acctbal"))
    gone = c.where("c_acctbal < 0").join(o, "c_custkey", "left_anti").select("c_custkey")
    store.merge_keyed(path, ["c_custkey"], 16, o, gone)
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")


def indexed_topk(spark, sf_dir):
    """The five nearest of every hundredth vector through a stored index; of the other vectors those of odd labels are stale."""
    path = work_path(spark, "vectors")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("text_hash"))
    vector_index.write_index(e, path, 64, cells=16, key="vec_id", vector="embedding", text_hash="text_hash")
    current = e.select(F.col("vec_id").alias("key"), F.when(F.col("text_hash").cast("int") % 2 == 0, F.col("text_hash")).otherwise("changed").alias("text_hash"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_index.search_index(spark, asked, path, 64, k=5, probes=16, minimum=-1.0, current=current)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("dense_score", 6).alias("dense_score"), "dense_rank")


QUERIES = {f.__name__: f for f in (processed_documents, processed_rules, ingested_concepts, log_stream_daily, merged_customers, indexed_topk)}

_CLEAN = "regexp_replace(regexp_replace(coalesce(text, ''), '\\s+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_QUOTED = ", ".join(f"'{w}'" for w in PROPOSED)
_FOUND = "list_filter([" + _QUOTED + "], lambda w: contains(piece, w))"
_HINT = "coalesce(list_min(list_filter(said, lambda x: x <> w)), '')"
_ACTION = "CASE w " + " ".join(f"WHEN '{w}' THEN '{a}'" for w, (_, a) in PROPOSED.items()) + " END"
_JOB = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id AS document_id, source AS org_id, {_CLEAN} AS t FROM documents), {chunks_sql('d')},
flagged AS (SELECT r, ordinal, piece, {boilerplate_sql('piece')} AS b, {candidate_sql(_N.replace('text', 'piece'), WORDS)} AS c FROM pieces),
chunk AS (SELECT *, NOT b AND c AS candidate, regexp_matches(piece, '{BROKEN}') AS broken FROM flagged),
said AS (SELECT r, ordinal, {_FOUND} AS said FROM chunk WHERE candidate AND NOT broken),
one AS (SELECT r, ordinal, w, {_HINT} AS hint, {_ACTION} AS action FROM (SELECT r, ordinal, said, unnest(said) AS w FROM said)),
rule AS (SELECT DISTINCT r, w, hint, action FROM one),
torn AS (SELECT DISTINCT a.r, a.w, a.hint FROM rule a JOIN rule b ON a.r = b.r AND a.action <> b.action AND (a.w = b.w OR a.w = b.hint OR a.hint = b.w OR (a.hint = b.hint AND a.hint <> ''))),
k AS (SELECT r, count(*) AS n_chunks, count_if(b) AS n_boilerplate, count_if(candidate) AS n_candidates FROM chunk GROUP BY r),
p AS (SELECT r, count(*) AS n_proposed FROM rule GROUP BY r), o AS (SELECT r, count(*) AS n FROM one GROUP BY r), x AS (SELECT r, count(*) AS n_conflicts FROM torn GROUP BY r),
w AS (SELECT r, count(*) AS n_pending FROM chunk LEFT JOIN said USING (r, ordinal) WHERE candidate AND (broken OR len(said) = 0) GROUP BY r)"""

ORACLE_SQL = {
    # all cells are visited here, so the answer is exact; tests measure recall with few
    "indexed_topk": """WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS s FROM e AS q, e WHERE q.vec_id % 100 = 0 AND e.label % 2 = 0)
SELECT query_id, vec_id, round(s, 6) AS dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS dense_rank FROM p QUALIFY dense_rank <= 5""",
    "log_stream_daily": "SELECT CAST(ts AS DATE) AS day, count(*) AS total, count_if(event_type IN ('error', 'purchase')) AS blocked, count_if(event_type NOT IN ('error', 'purchase')) AS allowed FROM events GROUP BY 1",
    "merged_customers": """WITH o AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN o USING (c_custkey) WHERE p IS NOT NULL OR c_acctbal >= 0""",
    # no document has a rule's header, and no chunk restricts, numbers or lists: the SQL counts both
    "processed_documents": _JOB
    + f""", h AS (SELECT r, count(*) AS n_rules FROM chunk WHERE NOT b AND (regexp_matches(piece, '(?m)^[\\-•●▪►◆*]') OR regexp_matches(piece, '(?:بند|ماده|تبصره|قانون|بخش)\\s*[0-9۰-۹]+') OR regexp_matches(piece, 'ممنوع|محرمانه|نباید')) GROUP BY r)
SELECT document_id, CASE WHEN t = '' THEN 'FAILED' ELSE 'READY' END AS status, CASE WHEN coalesce(n_rules, 0) > 0 THEN 'heuristic' ELSE 'none' END AS mode, 1::BIGINT AS n_pages,
  length({_N.replace('text', 't')}) AS n_chars, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_rules, 0) AS n_rules, 0::BIGINT AS n_known,
  coalesce(n_proposed, 0) AS n_proposed, coalesce(o.n, 0) - coalesce(n_proposed, 0) AS n_duplicates, coalesce(n_conflicts, 0) AS n_conflicts, 0::BIGINT AS n_rejected, coalesce(n_pending, 0) AS n_pending
FROM d LEFT JOIN k USING (r) LEFT JOIN p USING (r) LEFT JOIN o USING (r) LEFT JOIN x USING (r) LEFT JOIN w USING (r) LEFT JOIN h USING (r)""",
    "processed_rules": _JOB
    + """, h AS (SELECT r, count(*) AS n FROM chunk WHERE NOT b AND regexp_matches(piece, '(?m)^[\\-•●▪►◆*]') GROUP BY r),
n AS (SELECT org_id, CAST(sum(coalesce(n_proposed, 0) + coalesce(h.n, 0)) AS BIGINT) AS n_rules, CAST(sum(coalesce(n_conflicts, 0)) AS BIGINT) AS n_conflicts FROM d LEFT JOIN p USING (r) LEFT JOIN x USING (r) LEFT JOIN h USING (r) GROUP BY org_id)
SELECT org_id, n_rules, n_rules AS n_codes, n_rules AS highest, n_conflicts FROM n WHERE n_rules > 0""",
}
