"""Queries over conversations and decisions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from promptlake.functions import detectors
from promptlake.operators import conversations as conv
from promptlake.operators import rules
from promptlake.plans import decide, queries_text
from promptlake.plans.pipeline import detection, route_conversations
from promptlake.sources.readers import spread, table
from promptlake.streaming import logs


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def conv_last30(spark, sf_dir):
    last = conv.last_messages(conv.admitted(messages(spark, sf_dir)), conv.WINDOW)
    return last.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


def conv_last_user(spark, sf_dir):
    return conv.last_user_message(conv.admitted(messages(spark, sf_dir)))


def conv_payload_hash(spark, sf_dir):
    told = conv.folded(conv.admitted(messages(spark, sf_dir)))
    return told.select("conv_id", conv.payload_hash(F.col("payload")).alias("payload_hash"), F.col("n_messages").cast("bigint").alias("n_messages"), conv.estimated_tokens(F.col("payload")).alias("n_tokens"))


def conv_route(spark, sf_dir):
    return route_conversations(messages(spark, sf_dir)).drop("failed")


def _answered(normal, hits, candidates):
    """A stand-in for the model: the first candidate is matched where the text is long; hits are sensitive."""
    some = F.size(hits) > 0
    matched = F.when((F.length(normal) > 400) & (F.size(candidates) > 0), F.array(F.get(candidates, F.lit(0))["concept_key"])).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(some, "SENSITIVE").otherwise("SAFE").alias("decision"), F.when(some, "ORG_SPECIFIC").otherwise("GENERAL").alias("scope"), matched.alias("concepts"), F.lit(0.9).alias("confidence"), F.lit("local_llm").alias("method"))


def _policy(spark, sf_dir):
    """Benchmark texts as the policy's active concepts."""
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), k.cast("string")).alias("concept_key"), F.when(k % 3 == 0, "CONFIDENTIAL").otherwise("PUBLIC").alias("sensitivity"), F.when(k % 3 == 0, "ROUTE_LOCAL").when(k % 3 == 1, "ALLOW_EXTERNAL").otherwise("BLOCK").alias("action"), "text")


def detection_semantic(spark, sf_dir):
    """The second pipeline over all conversations, with retrieval over the benchmark's texts."""
    return detection(messages(spark, sf_dir), "semantic", concepts=_policy(spark, sf_dir), classifier=_answered).drop("failed")


_DIGEST_RUN = "[0-9a-f]{16,}"


def _digests(text: str, deadline: float) -> list[dict]:
    """A detector from outside: runs of hex digits as digests. It can't read a run of odd length, and says so by raising."""
    found = []
    for m in re.finditer(_DIGEST_RUN, text):
        bytes.fromhex(m[0])
        found.append({"detector_type": "REGEX", "rule_id": None, "label": "digest", "category": "digest", "confidence": 0.6, "start": m.start(), "end": m.end(), "text": m[0]})
    return found


_RULES = [
    {"id": "r1", "detector_type": "REGEX", "pattern": r"(?P<code>[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})", "action": "BLOCK_EXTERNAL"},
    {"id": "r2", "detector_type": "REGEX", "pattern": "([unclosed", "action": "BLOCK_EXTERNAL"},
    {"id": "r3", "detector_type": "REGEX", "pattern": "licensed under", "action": "LOCAL_ONLY"},
]


def dlp_isolated(spark, sf_dir):
    """Every document as a prompt, with rules of a policy and a detector that fails on some texts: their other hits stay, and they stay local."""
    docs = spread(table(spark, sf_dir, "documents"))
    prompts = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    routed = route_conversations(prompts, rules=_RULES, steps={"digests": detectors.foreign(_digests)})
    return routed.select(F.col("conv_id").alias("doc_id"), F.col("n_hits").cast("bigint").alias("n_hits"), "categories", "failed", "health", "sensitivity", "route", "decision", "action")


def policy_in_force(spark, sf_dir):
    """At each error event: which of its user's policies is in force. Event types are documents, active from a large value until a small one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").alias("at"))
    history = e.where("event_type <> 'error'").withColumn("status", F.when(F.col("value") > 60, "ACTIVE").otherwise("ARCHIVED"))
    return conv.policies_in_force(e.where("event_type = 'error'"), history, "event_id", tenant="user_id", document="event_type", order="event_id")


def layered_documents(spark, sf_dir):
    """The layered engine over all documents: identifiers and secrets, keyword rules, behaviour."""
    listed = spark.createDataFrame(queries_text.RULES, "code string, keywords array<string>, severity string, is_active boolean")
    text, normal = F.col("text"), F.col("normal")
    told = queries_text.normal(spark, sf_dir).withColumns(
        {"legacy": detectors.legacy_layer(text, normal), "hit": rules.keyword_hits(listed)(normal), "behaviour": detectors.behaviour(text, normal, ["only"], ["licensed"], queries_text.ORGANISATION)}
    )
    kinds = {"national_ids": ("CRITICAL", 1), "ibans": ("CRITICAL", 1), "cards": ("CRITICAL", 1), "secret_family": ("CRITICAL", 1), "emails": ("HIGH", 3), "mobiles": ("HIGH", 3)}
    found = F.array_compact(F.array(*(F.when(F.col(f"legacy.{k}") >= least, F.struct(F.lit(k).alias("code"), F.lit(severity).alias("severity"))) for k, (severity, least) in kinds.items())))
    code = lambda r: r["code"]
    sensitive = F.struct(F.col("legacy.score").alias("score"), F.col("legacy.blocked").alias("blocked"), F.transform(found, code).alias("reasons"), found.alias("rules"))
    keyword = F.struct(
        F.coalesce(F.array_max(F.transform("hit", lambda r: r["score"])), F.lit(0.0)).alias("score"),
        (F.size("hit") > 0).alias("blocked"),
        F.transform("hit", lambda r: F.concat(F.lit("rule "), r["code"])).alias("reasons"),
        F.transform("hit", lambda r: F.struct(r["code"].alias("code"), r["severity"].alias("severity"))).alias("rules"),
    )
    b = F.col("behaviour.score")
    behaviour = F.struct(b.alias("score"), (b > 0).alias("blocked"), F.when(F.col("behaviour.rewriting"), F.array(F.lit("rewriting"))).when(b > 0, F.array(F.lit("organisations"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.array().cast("array<struct<code: string, severity: string>>").alias("rules"))
    out = decide.layered(F.array(*(c.cast(decide.LAYER) for c in (sensitive, keyword, behaviour))))
    said = told.select("doc_id", out.alias("o"))
    return said.select("doc_id", "o.action", "o.score", F.array_join("o.reasons", ",").alias("reasons"), F.array_join(F.transform("o.rules", code), ",").alias("rules"), F.col("o.layers_run").cast("bigint").alias("layers_run"))


def detection_rules(spark, sf_dir):
    return detection(messages(spark, sf_dir), "rules", terms={"PROPRIETARY_SERVICE": ["que", "der"]})


def conv_route_counts(spark, sf_dir):
    return conv_route(spark, sf_dir).groupBy("route", "decision", "health").agg(F.count("*").alias("n"))


_GRID = {
    "health": ["HEALTHY", "DEGRADED"],
    "conflict": [False, True],
    "semantic": ["SAFE", "SENSITIVE", "UNCERTAIN"],
    "scope": ["GENERAL", "ORG_SPECIFIC", "UNKNOWN"],
    "action": ["ALLOW_EXTERNAL", "MASK_AND_ALLOW_EXTERNAL", "ROUTE_LOCAL", "BLOCK"],
    "always_block": [False, True],
    "has_hits": [False, True],
    "confidence": [0.69, 0.7, 0.95],
}


def _every(spark, grid):
    """All combinations of a few literal values: explosions of one row, no join."""
    one = spark.range(1).select()
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*(F.lit(v) for v in kv[1])))), grid.items(), one)


def route_truth_table(spark, sf_dir):
    told = _every(spark, _GRID).where("has_hits OR NOT always_block")
    c = F.col
    out = decide.decide(c("health"), c("conflict"), c("semantic"), c("scope"), c("confidence"), c("action"), c("always_block"), c("has_hits"))
    return told.withColumn("o", out).select(*_GRID, F.col("o.route").alias("route"), F.col("o.decision").alias("decision"), F.col("o.action").alias("runtime_action"))


_FUSION = {
    "semantic": ["SAFE", "SENSITIVE", "UNCERTAIN", "MISSING"],
    "matched_action": ["NONE", "ALLOW_EXTERNAL", "MASK_AND_ALLOW_EXTERNAL", "ROUTE_LOCAL", "BLOCK"],
    "matched_sensitivity": ["PUBLIC", "INTERNAL", "HIGHLY_CONFIDENTIAL"],
    "always_block": [False, True],
    "critical": [False, True],
    "dlp_failed": [False, True],
    "index_valid": [False, True],
}


def fusion_truth_table(spark, sf_dir):
    told = _every(spark, _FUSION).where("critical OR NOT always_block")
    c = F.col
    some = F.when(c("matched_action") != "NONE", F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    semantic = F.when(c("semantic") != "MISSING", F.struct(c("semantic").alias("decision"), F.lit("GENERAL").alias("scope"), some.alias("concepts"), F.lit(0.9).alias("confidence"), F.lit("local_llm").alias("method")))
    retrieved = F.array(F.struct(F.lit("k").alias("concept_key"), c("matched_sensitivity").alias("sensitivity"), c("matched_action").alias("action")))
    fused = decide.fuse(semantic, retrieved, c("always_block"), c("critical"), c("dlp_failed"), c("index_valid"), F.lit(False))
    return told.withColumn("f", fused).select(*_FUSION, F.col("f.health").alias("health"), F.col("f.sensitivity").alias("sensitivity"), F.col("f.action").alias("action"), F.col("f.conflict").alias("conflict"))


_GUARD = {
    "route": ["EXTERNAL_DIRECT", "EXTERNAL_MASKED", "LOCAL", "OTHER"],
    "action": ["EXTERNAL_ALLOWED", "LOCAL_ONLY"],
    "said_route": ["EXTERNAL_DIRECT", "OTHER"],
    "version": [1, 2],
    "payload": ["", "x", "y"],
    "category": ["none", "private_key"],
    "confidence": [0.69, 0.7],
    "health": ["HEALTHY", "DEGRADED"],
}


def egress_guard(spark, sf_dir):
    c = F.col
    outcome = F.struct(
        c("action").alias("action"),
        c("said_route").alias("route"),
        F.lit(1).alias("policy_version"),
        F.when(c("payload") == "", F.lit(None)).otherwise(F.sha2(F.lit("x"), 256)).alias("payload_hash"),
        F.array("category").alias("categories"),
        F.lit("SAFE").alias("decision"),
        c("health").alias("health"),
        F.lit("GENERAL").alias("scope"),
        c("confidence").alias("confidence"),
        F.lit(0).alias("n_hits"),
        F.lit(False).alias("external_used"),
    )
    told = _every(spark, _GUARD)
    return told.withColumn("violation", decide.guard(outcome, c("route"), c("payload"), c("version")))


_ANSWERS = [
    '{"decision":"safe","scope":"GENERAL","matchedConcepts":[],"confidence":0.9,"reasonFa":"ok"}',
    '<think>{"a":1}</think>```json\n{"decision":"SENSITIVE","scope":"x","matchedConcepts":["a","b"],"confidence":"0.75","reasonFa":" "}\n```',
    'so: {"decision":1,"matchedConcepts":"fin","confidence":2}',
    "no json",
    '{"decision":"UNCERTAIN","scope":"UNKNOWN","matchedConcepts":"one","confidence":"x"}',
]


def parsed_answers(spark, sf_dir):
    told = spark.createDataFrame(list(enumerate(_ANSWERS)), "id int, raw string").withColumn("p", decide.parsed_answer(F.col("raw")))
    return told.select("id", F.col("p").isNotNull().alias("ok"), F.col("p.decision").alias("decision"), F.col("p.scope").alias("scope"), F.array_join("p.concepts", ",").alias("concepts"), F.col("p.confidence").alias("confidence"))


def sse_parse(spark, sf_dir):
    """Each conversation's assistant texts as an event stream, parsed back into its answer."""
    said = conv.admitted(messages(spark, sf_dir)).where("role = 'assistant'")
    payload = F.to_json(F.struct(F.lit("delta").alias("type"), F.col("text").alias("delta")))
    bodies = logs.sse_rows(said.select("conv_id", F.col("turn").alias("seq"), payload.alias("payload")))
    events = logs.sse_events(F.col("body"))
    return bodies.select("conv_id", F.size(events).cast("bigint").alias("n_events"), F.sha2(logs.answer(events), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (conv_last30, conv_last_user, conv_payload_hash, conv_route, conv_route_counts, dlp_isolated, policy_in_force, layered_documents, detection_semantic, detection_rules, route_truth_table, fusion_truth_table, egress_guard, parsed_answers, sse_parse)
}


def _values(grid):
    cross = " CROSS JOIN ".join(f"(VALUES {', '.join(f'({v!r})' if isinstance(v, str) else f'({str(v).lower()})' for v in values)}) AS t_{name}({name})" for name, values in grid.items())
    return f"SELECT {', '.join(grid)} FROM {cross}"


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_SAID = f"SELECT conv_id, turn, role, {_TRIM} AS text FROM conversations WHERE role IN ('system', 'user', 'assistant') AND {_TRIM} <> ''"

_ROUTED = f"""
WITH s AS ({_SAID}), t AS (SELECT conv_id, turn, role, text FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 30),
p AS (SELECT conv_id, count(*) AS n_messages, string_agg(text, chr(10) ORDER BY turn, role, text) AS text, '[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}', ',' ORDER BY turn, role, text) || ']' AS payload FROM t GROUP BY conv_id),
h AS ({{evidence}}),
e AS (SELECT conv_id, CAST(sum(n) AS INT) AS n_hits, string_agg(category, ',' ORDER BY category) AS categories, bool_or(category = 'jailbreak_injection') AS always, bool_or(category IN ({queries_text._CRITICAL_SQL})) AS critical FROM h GROUP BY conv_id)"""
_ROUTE = (
    _ROUTED.replace("{evidence}", queries_text.evidence_sql("p", "conv_id"))
    + """, r AS (SELECT p.conv_id, n_messages, payload, coalesce(n_hits, 0) AS n_hits, coalesce(categories, '') AS categories, coalesce(always, false) AS always, coalesce(critical, false) AS critical, length(payload) > 24000 AS long FROM p LEFT JOIN e USING (conv_id)),
d AS (SELECT *, CASE WHEN always THEN 'BLOCKED' WHEN NOT long AND n_hits = 0 THEN 'EXTERNAL_DIRECT' ELSE 'LOCAL' END AS route FROM r)
SELECT conv_id, CAST(n_messages AS INT) AS n_messages, CAST(n_hits AS INT) AS n_hits, categories, CASE WHEN long THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
  CASE WHEN always THEN 'HIGHLY_CONFIDENTIAL' WHEN critical OR (n_hits > 0 AND NOT long) THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS sensitivity, route,
  CASE WHEN route = 'EXTERNAL_DIRECT' THEN 'SAFE' WHEN long AND route = 'LOCAL' THEN 'UNCERTAIN' ELSE 'SENSITIVE' END AS decision, CASE WHEN route = 'EXTERNAL_DIRECT' THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS action, sha256(payload) AS payload_hash FROM d"""
)

_PROMPTS = f"SELECT doc_id, n, text FROM (SELECT doc_id, text, {queries_text._N} AS n FROM (SELECT doc_id, {_TRIM} AS text FROM documents)) WHERE text <> ''"
_ISOLATED = f"""
WITH d AS ({_PROMPTS}), x AS (SELECT doc_id, text, n, regexp_extract_all(text, '{_DIGEST_RUN}') AS runs, '[' || '{{"role":"user","content":' || to_json(text) || '}}]' AS payload FROM d),
k AS (SELECT doc_id, payload, len(list_filter(runs, lambda r: length(r) % 2 = 1)) > 0 AS broken, len(runs) AS n_runs,
  least(3, len(regexp_extract_all(n, '[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}'))) AS r1, least(3, len(regexp_extract_all(n, 'licensed under'))) AS r3 FROM x),
h AS ({queries_text.evidence_sql("d", "doc_id")}),
e AS (SELECT doc_id, category, n FROM h UNION ALL SELECT doc_id, 'digest', n_runs FROM k WHERE NOT broken AND n_runs > 0 UNION ALL SELECT doc_id, 'policy_regex', r1 + r3 FROM k WHERE r1 + r3 > 0),
s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hits, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, bool_or(category = 'jailbreak_injection') AS always, bool_or(category IN ({queries_text._CRITICAL_SQL})) AS critical FROM e GROUP BY doc_id),
r AS (SELECT k.doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(categories, '') AS categories, coalesce(always, false) AS always, coalesce(critical, false) OR r1 > 0 AS critical, broken, length(payload) > 24000 AS long FROM k LEFT JOIN s USING (doc_id)),
o AS (SELECT *, CASE WHEN always THEN 'BLOCKED' WHEN NOT long AND NOT broken AND n_hits = 0 THEN 'EXTERNAL_DIRECT' ELSE 'LOCAL' END AS route FROM r)
SELECT doc_id, n_hits, categories, CASE WHEN broken THEN 'digests' ELSE '' END AS failed, CASE WHEN long OR broken THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
  CASE WHEN always THEN 'HIGHLY_CONFIDENTIAL' WHEN critical OR (n_hits > 0 AND NOT long) THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS sensitivity, route,
  CASE WHEN route = 'EXTERNAL_DIRECT' THEN 'SAFE' WHEN long AND route = 'LOCAL' THEN 'UNCERTAIN' ELSE 'SENSITIVE' END AS decision, CASE WHEN route = 'EXTERNAL_DIRECT' THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS action FROM o"""

ORACLE_SQL = {
    "conv_route": _ROUTE,
    "dlp_isolated": _ISOLATED,
    "policy_in_force": """
WITH h AS (SELECT event_id, user_id, event_type, ts, value > 60 AS active FROM events WHERE event_type <> 'error'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
last AS (SELECT q.event_id, h.event_type, arg_max(h.active, (h.ts, h.event_id)) AS active FROM q JOIN h ON h.user_id = q.user_id AND h.ts <= q.ts GROUP BY ALL),
n AS (SELECT event_id, count_if(active) AS n, max(event_type) FILTER (active) AS one FROM last GROUP BY event_id)
SELECT event_id, coalesce(n, 0) AS n_active, CASE WHEN n = 1 THEN one END AS document, coalesce(n, 0) = 1 AS in_force FROM q LEFT JOIN n USING (event_id)""",
    "layered_documents": f"""
WITH l AS ({queries_text.ORACLE_SQL['legacy_layer']}), x AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '{queries_text.SECRET_SQL}') AS secret FROM documents), k AS ({queries_text.ORACLE_SQL['keyword_rules']}), b AS ({queries_text.ORACLE_SQL['behaviour']}),
j AS (SELECT doc_id, concat_ws(',', CASE WHEN national_ids > 0 THEN 'national_ids' END, CASE WHEN ibans > 0 THEN 'ibans' END, CASE WHEN cards > 0 THEN 'cards' END, CASE WHEN secret THEN 'secret_family' END, CASE WHEN emails >= 3 THEN 'emails' END, CASE WHEN mobiles >= 3 THEN 'mobiles' END) AS one,
  national_ids > 0 OR ibans > 0 OR cards > 0 OR secret AS critical, l.score AS s1, codes, k.score AS s2, rewriting, b.score AS s3 FROM l JOIN x USING (doc_id) JOIN k USING (doc_id) JOIN b USING (doc_id)),
r AS (SELECT *, CASE WHEN critical THEN 1 WHEN list_contains(string_split(codes, ','), 'R-003') THEN 2 ELSE 3 END AS ran FROM j),
o AS (SELECT doc_id, ran, concat_ws(',', nullif(one, ''), CASE WHEN ran >= 2 AND codes <> '' THEN 'rule ' || replace(codes, ',', ',rule ') END, CASE WHEN ran >= 3 AND s3 > 0 THEN CASE WHEN rewriting THEN 'rewriting' ELSE 'organisations' END END) AS reasons,
  concat_ws(',', nullif(one, ''), CASE WHEN ran >= 2 AND codes <> '' THEN codes END) AS rules, greatest(s1, CASE WHEN ran >= 2 THEN s2 ELSE 0 END, CASE WHEN ran >= 3 THEN s3 ELSE 0 END) AS score FROM r)
SELECT doc_id, CASE WHEN reasons <> '' THEN 'BLOCK' ELSE 'ALLOW' END AS action, score::DOUBLE AS score, reasons, rules, ran::BIGINT AS layers_run FROM o""",
    "conv_route_counts": f"SELECT route, decision, health, count(*) AS n FROM ({_ROUTE}) GROUP BY ALL",
    "detection_rules": _ROUTED.replace("{evidence}", queries_text.evidence_sql("p", "conv_id", [("proprietary_service", "(?i)que|der")]))
    + """, m AS (SELECT p.conv_id, coalesce(least(n_hits, 100000), 0) AS n_hits, categories FROM p LEFT JOIN e USING (conv_id))
SELECT conv_id, CAST(coalesce(k.n, 0) AS INT) AS n_hits, CASE WHEN k.n IS NULL THEN 'SAFE' WHEN k.sure THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS decision, CASE WHEN k.n IS NULL THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS action
FROM m LEFT JOIN (SELECT conv_id, sum(CASE WHEN category = 'proprietary_service' THEN least(n, 201) ELSE n END) AS n, bool_or(category NOT LIKE 'bulk%') AS sure FROM h GROUP BY conv_id) k USING (conv_id)""",
    "conv_last30": f"SELECT conv_id, turn, role, length(text) AS n_chars FROM ({_SAID}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 30",
    "conv_last_user": f"SELECT conv_id, max({{'t': turn, 'x': text}}) FILTER (role = 'user').x AS text FROM ({_SAID}) GROUP BY conv_id".replace(
        "max({'t': turn, 'x': text}) FILTER (role = 'user').x", "(max({'t': turn, 'x': text}) FILTER (role = 'user')).x"
    ),
    "conv_payload_hash": f"""
WITH p AS (SELECT conv_id, count(*) AS n_messages, '[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}', ',' ORDER BY turn, role, text) || ']' AS p FROM ({_SAID}) GROUP BY conv_id)
SELECT conv_id, sha256(p) AS payload_hash, n_messages, greatest(1, CAST(ceil(length(p) / 4) AS BIGINT)) AS n_tokens FROM p""",
    "route_truth_table": f"""
WITH g AS ({_values(_GRID)}), r AS (SELECT *, CASE
  WHEN action = 'BLOCK' AND (always_block OR (health = 'HEALTHY' AND confidence >= 0.7 AND semantic = 'SENSITIVE')) THEN 1
  WHEN health <> 'HEALTHY' OR conflict OR semantic = 'UNCERTAIN' OR scope = 'UNKNOWN' OR confidence < 0.7 THEN 2
  WHEN action IN ('MASK_AND_ALLOW_EXTERNAL', 'ROUTE_LOCAL') OR semantic = 'SENSITIVE' OR scope = 'ORG_SPECIFIC' THEN 3
  WHEN semantic = 'SAFE' AND scope = 'GENERAL' AND NOT has_hits AND action = 'ALLOW_EXTERNAL' THEN 4 ELSE 5 END AS k FROM g WHERE has_hits OR NOT always_block)
SELECT health, conflict, semantic, scope, action, always_block, has_hits, confidence, ['BLOCKED', 'LOCAL', 'LOCAL', 'EXTERNAL_DIRECT', 'LOCAL'][k] AS route,
  CASE WHEN k = 2 THEN CASE WHEN semantic = 'UNCERTAIN' THEN 'UNCERTAIN' ELSE 'SENSITIVE' END ELSE ['SENSITIVE', '', 'SENSITIVE', 'SAFE', 'UNCERTAIN'][k] END AS decision,
  CASE WHEN k = 4 THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS runtime_action FROM r""",
    "fusion_truth_table": f"""
WITH g AS ({_values(_FUSION)}), m AS (SELECT *, semantic <> 'MISSING' AND matched_action <> 'NONE' AS hit, CASE WHEN semantic = 'MISSING' THEN 'UNCERTAIN' ELSE semantic END AS d FROM g WHERE critical OR NOT always_block),
r AS (SELECT *, greatest(CASE WHEN hit THEN list_position(['ALLOW_EXTERNAL', 'MASK_AND_ALLOW_EXTERNAL', 'ROUTE_LOCAL', 'BLOCK'], matched_action) ELSE 1 END,
    CASE WHEN always_block THEN 4 WHEN critical OR (d = 'SENSITIVE' AND NOT hit) OR d = 'UNCERTAIN' THEN 3 ELSE 1 END) AS a,
  greatest(CASE WHEN hit THEN list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'HIGHLY_CONFIDENTIAL'], matched_sensitivity) ELSE 1 END,
    CASE WHEN always_block THEN 4 WHEN critical OR (d = 'SENSITIVE' AND NOT hit) THEN 3 ELSE 1 END) AS s, critical AND semantic = 'SAFE' AS conflict FROM m)
SELECT semantic, matched_action, matched_sensitivity, always_block, critical, dlp_failed, index_valid,
  CASE WHEN NOT index_valid OR dlp_failed OR semantic = 'MISSING' OR conflict THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
  ['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'HIGHLY_CONFIDENTIAL'][s] AS sensitivity, ['ALLOW_EXTERNAL', 'MASK_AND_ALLOW_EXTERNAL', 'ROUTE_LOCAL', 'BLOCK'][a] AS action, conflict FROM r""",
    "egress_guard": f"""
WITH g AS ({_values(_GUARD)})
SELECT route, action, said_route, version, payload, category, confidence, health, CASE
  WHEN route = 'LOCAL' OR action <> 'EXTERNAL_ALLOWED' THEN 'route forbidden'
  WHEN said_route <> route THEN 'route contradicts outcome'
  WHEN version <> 1 THEN 'policy version mismatch'
  WHEN payload = 'y' THEN 'payload changed'
  WHEN category = 'private_key' THEN 'critical hit'
  WHEN route = 'EXTERNAL_DIRECT' AND (health <> 'HEALTHY' OR confidence < 0.7) THEN 'not safe'
  WHEN route = 'EXTERNAL_DIRECT' AND payload = '' THEN 'empty payload'
  WHEN route = 'EXTERNAL_MASKED' THEN 'masked egress disabled'
  WHEN route <> 'EXTERNAL_DIRECT' THEN 'unknown route' END AS violation FROM g""",
    "parsed_answers": "SELECT * FROM (VALUES (0, true, 'SAFE', 'GENERAL', '', 0.9::DOUBLE), (1, true, 'SENSITIVE', 'UNKNOWN', 'a,b', 0.75), (2, false, NULL, NULL, NULL, NULL), (3, false, NULL, NULL, NULL, NULL), (4, true, 'UNCERTAIN', 'UNKNOWN', 'one', 0.0)) AS t(id, ok, decision, scope, concepts, confidence)",
    "sse_parse": f"SELECT conv_id, count(*) AS n_events, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM ({_SAID}) WHERE role = 'assistant' GROUP BY conv_id",
}
