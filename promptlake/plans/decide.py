"""Evidence to decision: classification, fusion, routing, the guard before anything leaves.

Every step keeps each of its input rows; where evidence is missing the row gets the
closed answer (stay local), never a lost row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlake.functions.detectors import CRITICAL_V1
from promptlake.functions.patterns import text_of
from promptlake.functions.text import normalize, sha256, squeeze, strip
from promptlake.operators.ingestion import json_part

SENSITIVE_FROM, NOISE_BELOW, CONFIDENT_FROM = 0.85, 0.5, 0.7
SENSITIVITY = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "HIGHLY_CONFIDENTIAL"]
ACTION = ["ALLOW_EXTERNAL", "MASK_AND_ALLOW_EXTERNAL", "ROUTE_LOCAL", "BLOCK"]
RISK = ["low", "medium", "high", "critical"]


def place(order: list[str], value: Column) -> Column:
    """A value's place in an order from low to high; unknown values are lowest."""
    return F.greatest(F.array_position(F.array(*(F.lit(x) for x in order)), F.coalesce(value, F.lit(""))) - 1, F.lit(0)).cast("int")


def named(order: list[str], at: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in order)), at)


def max_risk(a: Column, b: Column) -> Column:
    return named(RISK, F.greatest(place(RISK, a), place(RISK, b)))


def classify(hits: Column, failed: Column | None = None) -> Column:
    """struct<decision, action, hits>: hits below the noise level are dropped; an error is never safe."""
    kept = F.filter(hits, lambda h: h["confidence"] >= NOISE_BELOW)
    most = F.array_max(F.transform(kept, lambda h: h["confidence"]))
    decision = F.when(F.size(kept) == 0, "SAFE").when(most >= SENSITIVE_FROM, "SENSITIVE").otherwise("UNCERTAIN")
    if failed is not None:
        decision = F.when(failed, "UNCERTAIN").otherwise(decision)
    return F.struct(decision.alias("decision"), F.when(decision == "SAFE", "EXTERNAL_ALLOWED").otherwise("LOCAL_ONLY").alias("action"), kept.alias("hits"))


def is_critical(hits: Column, blocking_rules: list[str] | None = None) -> Column:
    """Whether any hit halts the first pipeline."""
    return F.exists(hits, lambda h: h["category"].isin(*CRITICAL_V1) | (F.coalesce(h["rule_id"].isin(*blocking_rules), F.lit(False)) if blocking_rules else F.lit(False)))


def labels(hits: Column, concepts: Column | None = None) -> Column:
    """Different labels of hits (their category without one), then of concepts."""
    told = F.transform(hits, lambda h: F.coalesce(h["label"], h["category"]))
    if concepts is not None:
        told = F.concat(told, F.transform(concepts, lambda c: F.coalesce(c["category"], c["name"])))
    return F.array_distinct(told)


ANSWER = "struct<decision: string, scope: string, matchedConcepts: string, confidence: string, reasonFa: string>"


def parsed_answer(raw: Column) -> Column:
    """struct<decision, scope, concepts, confidence, reason> of a classifier's JSON answer, or null if it can't be used."""
    told = F.from_json(json_part(raw), ANSWER)
    one_of = lambda c, known, other: F.when(F.upper(F.trim(c)).isin(*known), F.upper(F.trim(c))).otherwise(other)
    listed = F.from_json(F.when(told["matchedConcepts"].startswith("["), told["matchedConcepts"]), "array<string>")
    single = F.when((F.trim(told["matchedConcepts"]) != "") & ~told["matchedConcepts"].startswith("["), F.array(F.trim(told["matchedConcepts"])))
    concepts = F.coalesce(F.transform(listed, lambda x: F.trim(x)), single)
    confidence = F.coalesce(told["confidence"].try_cast("double"), F.lit(0.0))
    good = concepts.isNotNull() & ~F.exists(concepts, lambda c: F.coalesce(c, F.lit("")) == "") & confidence.between(0, 1)
    reason = F.trim(F.coalesce(told["reasonFa"], F.lit("")))
    answer = F.struct(
        one_of(told["decision"], ["SAFE", "SENSITIVE", "UNCERTAIN"], "UNCERTAIN").alias("decision"),
        one_of(told["scope"], ["GENERAL", "ORG_SPECIFIC", "UNKNOWN"], "UNKNOWN").alias("scope"),
        concepts.alias("concepts"),
        confidence.alias("confidence"),
        F.when(reason != "", reason).otherwise("تحلیل معنایی پرامپت با مدل محلی انجام شد.").alias("reason"),
    )
    return F.when(good, answer)


# Categories of the first classifier.
LEGACY_CATEGORIES = [
    "general",
    "standards_docs",
    "marketing_content",
    "translation_editing",
    "public_code",
    "faq_support",
    "cdr_traffic",
    "network_infrastructure",
    "source_code_systems",
    "tenders_contracts",
    "board_minutes_budget",
    "customer_behavior_analysis",
    "personal_data",
    "jailbreak_injection",
]


def parsed_legacy(raw: Column) -> Column:
    """struct<is_sensitive, category, risk_level, reason>, or null where the risk is unknown."""
    told = F.from_json(json_part(raw), "struct<is_sensitive: boolean, category: string, risk_level: string, reason: string>")
    risk = F.lower(F.trim(told["risk_level"]))
    category = F.when(told["category"].isin(*LEGACY_CATEGORIES), told["category"]).otherwise("general")
    return F.when(
        risk.isin(*RISK),
        F.struct((F.coalesce(told["is_sensitive"], F.lit(False)) | (risk != "low")).alias("is_sensitive"), category.alias("category"), risk.alias("risk_level"), F.coalesce(told["reason"], F.lit("")).alias("reason")),
    )


def reviewed_example(messages: DataFrame, concepts: DataFrame) -> DataFrame:
    """(conv_id, concept_key, applies): conversations of one user message that equals a reviewed example.

    A message that is both a positive and a negative example decides nothing.
    concepts has (concept_key, positive_examples, negative_examples).
    """
    same = lambda c: F.lower(squeeze(strip(normalize(c))))
    spoken = messages.where(F.col("role") != "system")
    single = spoken.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("role").alias("role"), F.max("text").alias("text")).where("n = 1 AND role = 'user'")
    asked = single.select("conv_id", sha256(same(F.col("text"))).alias("h"))
    example = lambda c, applies: concepts.select("concept_key", F.explode(c).alias("e"), F.lit(applies).alias("applies"))
    told = example("positive_examples", True).unionByName(example("negative_examples", False)).select("concept_key", "applies", sha256(same(F.col("e"))).alias("h")).distinct()
    hits = asked.join(told, "h").groupBy("conv_id", "concept_key").agg(F.collect_set("applies").alias("a"))
    return hits.where(F.size("a") == 1).select("conv_id", "concept_key", F.col("a")[0].alias("applies"))


def candidates(concepts: Column) -> Column:
    """Retrieved concepts as a classifier gets them: missing sensitivity and action filled in, blocking ones first.

    concepts: array<struct<concept_key, sensitivity, action, ...>>; the order within blocking and others stays.
    """
    filled = F.transform(
        concepts,
        lambda c, i: F.struct(
            F.when(F.coalesce(c["action"], F.lit("")) == "BLOCK", 0).otherwise(1).alias("first"),
            i.alias("at"),
            c.withField("sensitivity", F.coalesce(c["sensitivity"], F.lit("CONFIDENTIAL"))).withField("action", F.coalesce(c["action"], F.lit("ROUTE_LOCAL"))).alias("c"),
        ),
    )
    return F.transform(F.array_sort(filled, lambda a, b: F.when((a["first"] * 1_000_000 + a["at"]) < (b["first"] * 1_000_000 + b["at"]), -1).otherwise(1)), lambda x: x["c"])


def checked_answer(proposed: Column, retrieved: Column, verified: Column) -> Column:
    """struct<decision, scope, concepts, confidence, method>: unknown or unverified concepts make the answer uncertain;
    a verified concept that doesn't allow sending makes it sensitive.

    retrieved: array<struct<concept_key, action>>; verified: array<struct<concept_key, applies>>.
    """
    known = F.transform(retrieved, lambda c: c["concept_key"])
    failed = (F.size(F.array_except(proposed["concepts"], known)) > 0) | F.exists(verified, lambda v: v["applies"].isNull())
    held = F.transform(F.filter(verified, lambda v: v["applies"]), lambda v: v["concept_key"])
    closed = F.exists(retrieved, lambda c: F.array_contains(held, c["concept_key"]) & (c["action"] != "ALLOW_EXTERNAL"))
    empty = F.expr("cast(array() as array<string>)")
    answer = lambda d, s, c, p, m: F.struct(F.lit(d).alias("decision") if isinstance(d, str) else d.alias("decision"), F.lit(s).alias("scope") if isinstance(s, str) else s.alias("scope"), c.alias("concepts"), p.alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(proposed.isNull() | failed, answer("UNCERTAIN", "UNKNOWN", empty, F.coalesce(proposed["confidence"], F.lit(0.0)), "fallback"))
        .when(closed, answer("SENSITIVE", "ORG_SPECIFIC", held, proposed["confidence"], "local_llm"))
        .otherwise(answer(proposed["decision"], proposed["scope"], held, proposed["confidence"], "local_llm"))
    )


def fuse(semantic: Column, concepts: Column, always_block: Column, critical: Column, dlp_failed: Column, index_valid: Column, degraded: Column) -> Column:
    """struct<health, sensitivity, action, decision, scope, confidence, conflict, matched>.

    semantic: struct<decision, scope, concepts, confidence, method> or null; concepts: the retrieved array<struct<concept_key, sensitivity, action>>.
    """
    no = F.lit(False)
    decision = F.coalesce(semantic["decision"], F.lit("UNCERTAIN"))
    matched = F.coalesce(F.filter(concepts, lambda c: F.array_contains(semantic["concepts"], c["concept_key"])), F.filter(concepts, lambda c: F.lit(False)))
    top = lambda order, name: F.coalesce(F.array_max(F.transform(matched, lambda c: place(order, c[name]))), F.lit(0))
    lone = (decision == "SENSITIVE") & (F.size(matched) == 0)
    floor_action = F.when(always_block, 3).when(critical | lone | (decision == "UNCERTAIN"), 2).otherwise(0)
    floor_sensitivity = F.when(always_block, 3).when(critical | lone, 2).otherwise(0)
    conflict = critical & F.coalesce(semantic["decision"] == "SAFE", no)
    sick = ~index_valid | dlp_failed | degraded | semantic.isNull() | F.coalesce(semantic["method"] == "fallback", no) | conflict
    return F.struct(
        F.when(sick, "DEGRADED").otherwise("HEALTHY").alias("health"),
        named(SENSITIVITY, F.greatest(top(SENSITIVITY, "sensitivity"), floor_sensitivity)).alias("sensitivity"),
        named(ACTION, F.greatest(top(ACTION, "action"), floor_action)).alias("action"),
        decision.alias("decision"),
        F.coalesce(semantic["scope"], F.lit("UNKNOWN")).alias("scope"),
        F.coalesce(semantic["confidence"], F.lit(0.0)).alias("confidence"),
        conflict.alias("conflict"),
        F.transform(matched, lambda c: c["concept_key"]).alias("matched"),
    )


def decide(health: Column, conflict: Column, semantic: Column, scope: Column, confidence: Column, action: Column, always_block: Column, has_hits: Column, confident: float = CONFIDENT_FROM) -> Column:
    """struct<route, decision, action>, the first fitting case."""
    sure = confidence >= confident
    blocked = (action == "BLOCK") & (always_block | ((health == "HEALTHY") & sure & (semantic == "SENSITIVE")))
    closed = (health != "HEALTHY") | conflict | (semantic == "UNCERTAIN") | (scope == "UNKNOWN") | ~sure
    local = (action == "MASK_AND_ALLOW_EXTERNAL") | (action == "ROUTE_LOCAL") | (semantic == "SENSITIVE") | (scope == "ORG_SPECIFIC")
    free = (semantic == "SAFE") & sure & (scope == "GENERAL") & ~has_hits & (action == "ALLOW_EXTERNAL")
    out = lambda route, decision: F.struct(F.lit(route).alias("route"), (F.lit(decision) if isinstance(decision, str) else decision).alias("decision"), F.lit("EXTERNAL_ALLOWED" if route == "EXTERNAL_DIRECT" else "LOCAL_ONLY").alias("action"))
    return (
        F.when(blocked, out("BLOCKED", "SENSITIVE"))
        .when(closed, out("LOCAL", F.when(semantic == "UNCERTAIN", "UNCERTAIN").otherwise("SENSITIVE")))
        .when(local, out("LOCAL", "SENSITIVE"))
        .when(free, out("EXTERNAL_DIRECT", "SAFE"))
        .otherwise(out("LOCAL", "UNCERTAIN"))
    )


def guard(outcome: Column, route: Column, payload: Column, version: Column | None = None) -> Column:
    """The first reason why a payload must not leave, or null.

    outcome: struct<action, route, policy_version, payload_hash, categories, decision, health, scope, confidence, n_hits, external_used>.
    """
    no = F.lit(False)
    direct = route.isin("EXTERNAL_DIRECT", "EXTERNAL")
    unfit = (
        (outcome["decision"] != "SAFE")
        | (outcome["health"] != "HEALTHY")
        | F.coalesce(outcome["scope"] != "GENERAL", F.lit(True))
        | (F.coalesce(outcome["confidence"], F.lit(0.0)) < CONFIDENT_FROM)
        | (outcome["n_hits"] > 0)
    )
    reason = F.when(F.coalesce(outcome["external_used"], no), "external model used in detection")
    reason = reason.when(F.coalesce(route.isin("LOCAL", "BLOCKED"), no) | (outcome["action"] != "EXTERNAL_ALLOWED"), "route forbidden")
    reason = reason.when(F.coalesce((outcome["route"] != route) & (route != "EXTERNAL"), no), "route contradicts outcome")
    if version is not None:
        reason = reason.when(version.isNotNull() & ~outcome["policy_version"].eqNullSafe(version), "policy version mismatch")
    reason = reason.when(F.coalesce(sha256(text_of(payload)) != outcome["payload_hash"], no), "payload changed")
    reason = reason.when(F.arrays_overlap(outcome["categories"], F.array(F.lit("private_key"), F.lit("jailbreak_injection"))), "critical hit")
    reason = reason.when(direct & unfit, "not safe").when(direct & (text_of(payload) == ""), "empty payload")
    return reason.when(F.coalesce(route == "EXTERNAL_MASKED", no), "masked egress disabled").when(~F.coalesce(direct, no), "unknown route")


def first_engine(layers: list[tuple[Column, Column]]) -> Column:
    """struct<action, score, layers_run> of the layered engine: layers are (score, critical); the first critical one ends it.

    A null score (the layer failed, or there was no policy) blocks.
    """
    stop, score, ran = F.lit(False), F.lit(0.0), F.lit(0)
    failed = F.lit(False)
    for value, critical in layers:
        failed = failed | (~stop & value.isNull())
        score = F.when(stop, score).otherwise(F.greatest(score, F.coalesce(value, F.lit(0.0))))
        ran = F.when(stop, ran).otherwise(ran + 1)
        stop = stop | (F.coalesce(critical, F.lit(False)))
    return F.struct(
        F.when(failed | (score > 0), "BLOCK").otherwise("ALLOW").alias("action"),
        F.when(failed, 1.0).otherwise(score).alias("score"),
        ran.alias("layers_run"),
    )


#: What a layer of the layered engine says; a null layer is one that failed.
LAYER = "struct<score: double, blocked: boolean, reasons: array<string>, rules: array<struct<code: string, severity: string>>>"
# Reasons when there is nothing to judge by, and when a layer fails.
NO_POLICY, FAILED_LAYER = "امکان ارزیابی سیاست‌های سازمان وجود ندارد", "خطا در ارزیابی سیاست‌های سازمان"


def layered(layers: Column, has_policy: Column | None = None) -> Column:
    """struct<action, score, reasons, rules, layers_run> of the layered engine.

    layers: array of LAYER in order, folded in one pass. Reasons and rules gather over the layers, each
    reason once and the first rule of each code; the score is the largest. The run ends after a layer that blocks once any gathered rule is
    CRITICAL. Any reason blocks. Without a policy, or if a layer that runs has failed, the answer is BLOCK with score 1 and that reason alone.
    """
    start = F.expr(
        "struct(false as stop, false as failed, 0D as score, 0 as ran, cast(array() as array<string>) as reasons, cast(array() as array<struct<code: string, severity: string>>) as rules)"
    )

    def step(s: Column, x: Column) -> Column:
        seen = F.transform(s["rules"], lambda r: r["code"])
        # the first of each code, also within the layer
        own = F.coalesce(x["rules"], s["rules"])
        codes = F.transform(own, lambda r: r["code"])
        new = F.filter(own, lambda r, i: ~F.coalesce(F.array_contains(seen, r["code"]), F.lit(False)) & (F.array_position(codes, r["code"]) == i + 1))
        rules = F.concat(s["rules"], new)
        reasons = F.array_distinct(F.concat(s["reasons"], F.coalesce(x["reasons"], F.array().cast("array<string>"))))
        critical = F.coalesce(x["blocked"], F.lit(False)) & F.exists(rules, lambda r: F.coalesce(r["severity"] == "CRITICAL", F.lit(False)))
        gone = F.struct(F.lit(True).alias("stop"), F.lit(True).alias("failed"), F.lit(1.0).alias("score"), (s["ran"] + 1).alias("ran"), s["reasons"].alias("reasons"), s["rules"].alias("rules"))
        went = F.struct(critical.alias("stop"), F.lit(False).alias("failed"), F.greatest(s["score"], F.coalesce(x["score"], F.lit(0.0))).alias("score"), (s["ran"] + 1).alias("ran"), reasons.alias("reasons"), rules.alias("rules"))
        return F.when(s["stop"], s).when(x.isNull(), gone).otherwise(went)

    def closed(reason: str, ran: Column) -> Column:
        return F.struct(F.lit("BLOCK").alias("action"), F.lit(1.0).alias("score"), F.array(F.lit(reason)).alias("reasons"), start["rules"].alias("rules"), ran.alias("layers_run"))

    def finish(s: Column) -> Column:
        some = F.size(s["reasons"]) > 0
        told = F.struct(F.when(some, "BLOCK").otherwise("ALLOW").alias("action"), F.when(some, s["score"]).otherwise(0.0).alias("score"), s["reasons"].alias("reasons"), s["rules"].alias("rules"), s["ran"].alias("layers_run"))
        return F.when(s["failed"], closed(FAILED_LAYER, s["ran"])).otherwise(told)

    told = F.aggregate(layers, start, step, finish)
    return told if has_policy is None else F.when(F.coalesce(has_policy, F.lit(False)), told).otherwise(closed(NO_POLICY, F.lit(0)))


def closed_where_missing(decisions: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """One row for every input; those without a decision are UNCERTAIN, LOCAL, FAILED."""
    told = inputs.select(key).distinct().join(decisions, key, "left")
    closed = {"route": "LOCAL", "decision": "UNCERTAIN", "action": "LOCAL_ONLY", "health": "FAILED"}
    return told.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in closed.items() if c in decisions.columns})


def closed_unless(decisions: DataFrame, states: DataFrame, key: str, state: str) -> DataFrame:
    """decisions, closed (UNCERTAIN, LOCAL, FAILED) where the key's state isn't true; keys without a state are closed, too."""
    open_ = states.groupBy(key).agg(F.coalesce(F.bool_and(state), F.lit(False)).alias("open__"))
    told = decisions.join(open_, key, "left").withColumn("open__", F.coalesce("open__", F.lit(False)))
    closed = {"route": "LOCAL", "decision": "UNCERTAIN", "action": "LOCAL_ONLY", "health": "FAILED"}
    return told.withColumns({c: F.when(F.col("open__"), F.col(c)).otherwise(v) for c, v in closed.items() if c in decisions.columns}).drop("open__")


def log_fields(route: Column, risk: Column) -> Column:
    """struct<action, risk, route> as the decision log stores them."""
    blocked, local = route == "BLOCKED", route == "LOCAL"
    return F.struct(
        F.when(blocked, "BLOCK").otherwise("ALLOW").alias("action"),
        F.when(blocked, "critical").when(local, F.when(risk.isin("high", "critical"), "high").otherwise("medium")).otherwise("low").alias("risk"),
        route.alias("route"),
    )


def notice(hit_labels: Column, reason: Column, masks: Column) -> Column:
    """What a user is told about a request that stays local."""
    line = lambda name, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.array_join(F.array_compact(F.array(line("labels", F.array_join(hit_labels, ", ")), line("reason", reason), line("masked", masks))), "\n")


def source_address(forwarded: Column, real: Column) -> Column:
    """The first forwarded address, else the real one, else `unknown`."""
    first = F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))
