"""The detection pipeline over conversations, as one composition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlake.functions import detectors as det
from promptlake.functions.detectors import dlp_outcome
from promptlake.functions.text import normalize
from promptlake.functions.vectors import hashed_words
from promptlake.operators import conversations as conv
from promptlake.operators import scoring
from promptlake.plans import decide

#: Maps (normalised text, hits) to struct<decision, scope, concepts, confidence, method>.
Classifier = Callable[[Column, Column], Column]


def cautious(normal: Column, hits: Column) -> Column:
    """A deterministic classifier: any hit is sensitive, everything else safe and general. It stands in for a model."""
    some = F.size(hits) > 0
    return F.struct(
        F.when(some, "SENSITIVE").otherwise("SAFE").alias("decision"),
        F.when(some, "ORG_SPECIFIC").otherwise("GENERAL").alias("scope"),
        F.expr("cast(array() as array<string>)").alias("concepts"),
        F.lit(0.9).alias("confidence"),
        F.lit("local_llm").alias("method"),
    )


def _inspected(messages: DataFrame, terms=None, rules=None, steps=None) -> DataFrame:
    """Conversations with their payload, normal text, hits, the steps that failed, and what follows from them at once."""
    told = conv.folded(conv.last_messages(conv.admitted(messages)))
    told = told.withColumn("normal", normalize(F.col("dlp_text")))
    told = told.withColumn("dlp", dlp_outcome(F.col("dlp_text"), F.col("normal"), terms, rules, steps))
    told = told.withColumns({"hits": F.col("dlp.hits"), "failed": F.col("dlp.failed")}).drop("dlp")
    always, critical = F.exists("hits", lambda h: h["always_block"]), F.exists("hits", lambda h: h["severity"] == "critical")
    return told.withColumns({"always": always, "critical": critical, "too_long": F.length("payload") > conv.MAX_PAYLOAD})


def _decided(inspected: DataFrame, semantic: Column, concepts: Column, degraded: Column, index_valid: Column | None = None) -> DataFrame:
    """inspected with `fused` and `outcome`. A failed step or an unfit index degrades, and what is degraded stays local."""
    valid = F.lit(True) if index_valid is None else F.coalesce(index_valid, F.lit(False))
    fused = decide.fuse(semantic, concepts, F.col("always"), F.col("critical"), F.size("failed") > 0, valid, degraded)
    told = inspected.withColumn("fused", fused)
    f = lambda name: F.col(f"fused.{name}")
    return told.withColumn("outcome", decide.decide(f("health"), f("conflict"), f("decision"), f("scope"), f("confidence"), f("action"), F.col("always"), F.size("hits") > 0))


def route_conversations(
    messages: DataFrame,
    classifier: Classifier = cautious,
    terms: dict[str, list[str]] | None = None,
    rules: list[dict] | None = None,
    concepts: Column | None = None,
    steps: dict | None = None,
    in_force: DataFrame | None = None,
) -> DataFrame:
    """(conv_id, n_messages, n_hits, categories, failed, health, sensitivity, route, decision, action, payload_hash) of every conversation.

    `failed` names the steps that failed for it. With `in_force` (conv_id, in_force) a conversation
    without just one policy in force is closed: FAILED, UNCERTAIN and LOCAL, whatever its evidence.
    """
    told = _inspected(messages, terms, rules, steps)
    found = concepts if concepts is not None else F.expr(f"cast(array() as {_CONCEPT})")
    told = told.withColumn("semantic", F.when(~F.col("too_long"), classifier(F.col("normal"), F.col("hits"))))
    told = _decided(told, F.col("semantic"), found, F.col("too_long"))
    out = told.select(
        "conv_id",
        "n_messages",
        F.size("hits").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["category"]))), ",").alias("categories"),
        F.array_join("failed", ",").alias("failed"),
        F.col("fused.health").alias("health"),
        F.col("fused.sensitivity").alias("sensitivity"),
        F.col("outcome.route").alias("route"),
        F.col("outcome.decision").alias("decision"),
        F.col("outcome.action").alias("action"),
        conv.payload_hash(F.col("payload")).alias("payload_hash"),
    )
    return out if in_force is None else decide.closed_unless(out, in_force, "conv_id", "in_force")


_CONCEPT = "array<struct<concept_key: string, sensitivity: string, action: string>>"


def retrieved(prompts: DataFrame, concepts: DataFrame, key: str = "conv_id", k: int = 5, dim: int = 64, minimum: float = 0.45) -> DataFrame:
    """(key, concepts): each prompt's k best concepts by reciprocal-rank fusion of dense and lexical ranks, the best first.

    prompts has (key, normal); concepts has (concept_key, sensitivity, action, text), the
    policy's active ones. Prompts that no concept answers are missing.
    """
    asked = prompts.select(F.col(key).alias("query_id"), F.col("normal").alias("text"))
    told = concepts.select(F.col("concept_key").alias("id"), normalize(F.col("text")).alias("text"))
    vectors = lambda df, name: df.select(name, hashed_words(F.col("text"), dim).alias("vector"))
    dense = scoring.dense_top_blocks(vectors(asked, "query_id"), vectors(told, "id"), k=2 * k, minimum=minimum)
    lexical = scoring.lexical_ranks(scoring.bm25(asked, told, chunk_key="id"))
    best = scoring.fused(dense, lexical, k=k).join(concepts.select(F.col("concept_key").alias("id"), "sensitivity", "action"), "id")
    ranked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("concept_key"), "sensitivity", "action"))).alias("r"))
    return ranked.select(F.col("query_id").alias(key), F.transform("r", lambda x: F.struct(x["concept_key"].alias("concept_key"), x["sensitivity"].alias("sensitivity"), x["action"].alias("action"))).alias("concepts"))


def detect(
    messages: DataFrame,
    concepts: DataFrame,
    classifier: Callable[[Column, Column, Column], Column],
    terms: dict[str, list[str]] | None = None,
    rules: list[dict] | None = None,
    k: int = 5,
    steps: dict | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """(conv_id, n_hits, n_concepts, failed, health, sensitivity, route, decision, action) by the second pipeline.

    Texts that always block are decided from their hits alone: neither retrieval nor the
    classifier sees them. The rest meets the retrieved concepts; a prompt without any is
    judged, but degraded, and so is one for which a step failed. `index` is one row with
    `healthy` (see scoring.index_health): an unfit index finds nothing and degrades all. Payloads over the
    limit are closed (FAILED). The classifier maps
    (normalised text, hits, candidates) to struct<decision, scope, concepts, confidence, method>.
    """
    told = _inspected(messages, terms, rules, steps)
    # one row of one column
    told = told.withColumn("healthy", F.lit(True)) if index is None else told.crossJoin(F.broadcast(index.agg(F.coalesce(F.bool_and("healthy"), F.lit(False)).alias("healthy"))))
    nothing = F.expr(f"cast(array() as {_CONCEPT})")
    open_ = told.where("NOT always AND NOT too_long")
    found = open_.join(retrieved(open_.select("conv_id", "normal"), concepts, k=k), "conv_id", "left")
    found = found.withColumn("concepts", decide.candidates(F.when(F.col("healthy"), F.coalesce("concepts", nothing)).otherwise(nothing)))
    answer = classifier(F.col("normal"), F.col("hits"), F.col("concepts"))
    found = found.withColumn("semantic", decide.checked_answer(answer, F.col("concepts"), F.transform(answer["concepts"], lambda c: F.struct(c.alias("concept_key"), F.lit(True).alias("applies")))))
    found = _decided(found, F.col("semantic"), F.col("concepts"), F.size("concepts") == 0, F.col("healthy"))
    none = F.expr("cast(null as struct<decision: string, scope: string, concepts: array<string>, confidence: double, method: string>)")
    blocked = _decided(told.where("always AND NOT too_long").withColumn("concepts", nothing), none, F.col("concepts"), F.lit(False))
    columns = ["conv_id", F.size("hits").alias("n_hits"), F.size("concepts").alias("n_concepts"), F.array_join("failed", ",").alias("failed"), "fused.health", "fused.sensitivity", "outcome.route", "outcome.decision", "outcome.action"]
    return decide.closed_where_missing(found.select(*columns).unionByName(blocked.select(*columns)), told, "conv_id")


def detect_first(messages: DataFrame, terms: dict[str, list[str]] | None = None, rules: list[dict] | None = None) -> DataFrame:
    """(conv_id, n_hits, decision, action) by the first pipeline: detectors and classification, no retrieval."""
    told = conv.folded(conv.last_messages(conv.admitted(messages)))
    told = told.withColumn("normal", normalize(F.col("dlp_text")))
    text, normal = F.col("dlp_text"), F.col("normal")
    every = F.concat(
        det.national_ids(normal), det.bank_cards(normal), det.ibans(normal), det.secrets(text), det.bulk_contacts(text, normal),
        det.dictionary(text, terms or {}), det.compiled_rules(normal, rules or []), det.jailbreaks(normal),
    )
    out = decide.classify(every)
    return told.select("conv_id", out.alias("o")).select("conv_id", F.size("o.hits").alias("n_hits"), "o.decision", "o.action")


def detection(messages: DataFrame, mode: str, concepts: DataFrame | None = None, classifier=None, **options) -> DataFrame:
    """The pipeline of a mode: `semantic` (needs concepts and a classifier) or `rules`."""
    if mode == "semantic":
        return detect(messages, concepts, classifier, **options)
    if mode == "rules":
        return detect_first(messages, **options)
    raise ValueError("mode must be semantic or rules")
