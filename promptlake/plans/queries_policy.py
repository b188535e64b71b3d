"""Queries over policy tables: documents, concepts, rules, examples, logs and their changes.

The given tables stand in for the policy's: customers for documents, orders for
concepts, parts for rules. `_SQL` maps them in the same way for the SQL beside.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.functions import text as t
from promptlake.operators import conversations, evaluation, ingestion, repair, rules, scoring, store
from promptlake.plans import decide
from promptlake.sources import logs
from promptlake.sources.readers import spread, table

NOW = "2024-01-15 12:00:00"
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_KINDS = ["SENIOR_OFFICER", "TELCO_HUB_NODE", "PROPRIETARY_SERVICE"]
_STATES = ["DRAFT", "REVIEW", "ACTIVE", "ARCHIVED"]
_REVIEW = ["DRAFT", "PENDING_LLM", "REVIEW", "ACTIVE", "REJECTED"]
_ACTIONS = ["BLOCK_EXTERNAL", "MASK", "FLAG_REVIEW"]
_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _of(names, n):
    """The name at a number's place."""
    return F.get(F.array(*(F.lit(x) for x in names)), n.cast("int"))


def documents(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("document_id"),
        F.concat(F.lit("org-"), (F.col("c_nationkey") % 3).cast("string")).alias("org_id"),
        _of(_STATES, k % 4).alias("status"),
        F.when(F.col("c_acctbal") > 0, "READY").otherwise("PENDING").alias("processing"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def concepts(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "DRAFT").otherwise("REVIEW")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("document_id"),
        F.concat(F.lit("k"), k.cast("string")).alias("concept_key"),
        status.alias("review_status"),
        F.when(k % 7 != 0, (k % 100) / 100).alias("confidence"),
        F.when(k % 5 == 0, F.array(F.lit("LOOKS_TOO_BROAD"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.col("o_orderpriority").alias("source_quote"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        _of(decide.SENSITIVITY, k % 4).alias("sensitivity"),
        _of(decide.ACTION, k % 4).alias("action"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def policy_rules(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        k.alias("ordinal"),
        F.when(k % 10 != 0, k % 100).alias("document_id"),
        F.when(k % 3 == 0, "MANUAL").otherwise("AUTO").alias("origin"),
        _of(_REVIEW, F.col("p_size") % 5).alias("status"),
        (k % 2 == 0).alias("is_active"),
        _of(_SEVERITIES, k % 4).alias("severity"),
        _of(_ACTIONS, k % 3).alias("action"),
        F.concat(F.lit("R."), k.cast("string")).alias("code"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("keywords"),
        _of(["REGEX", "SEMANTIC", "CHECKSUM"], k % 3).alias("detector_type"),
        F.when(k % 6 == 0, "([unclosed").when(k % 9 == 0, "").otherwise(F.col("p_brand")).alias("regex_source"),
        F.when(k % 4 == 0, "IBAN").alias("checksum_kind"),
        (F.col("p_size") % 7).alias("priority"),
        (F.col("p_size") % 3).alias("scope_size"),
    )


def document_activation(spark, sf_dir):
    """One organisation's document goes live; a second call names a document of another one and changes nothing."""
    docs = store.activated(documents(spark, sf_dir), 1, "org-1")
    return store.activated(docs, 1, "org-9").select("document_id", "org_id", "status")


def lifecycle_stamps(spark, sf_dir):
    none = F.lit(None).cast("timestamp")
    old = documents(spark, sf_dir).withColumns({"activated_at": none, "archived_at": none})
    new = old.withColumn("status", F.when(F.col("document_id") % 8 == 1, "ACTIVE").when(F.col("document_id") % 8 == 2, "ARCHIVED").otherwise(F.col("status")))
    told = store.stamped(new, old, "document_id", F.lit(NOW).cast("timestamp"))
    now = F.lit(NOW).cast("timestamp")
    return told.select("document_id", "status", (F.col("updated_at") == now).alias("touched"), F.col("activated_at").isNotNull().alias("activated"), F.col("archived_at").isNotNull().alias("archived"))


def owned_concepts(spark, sf_dir):
    """One document by its key and tenant, and all concepts of that tenant."""
    docs = documents(spark, sf_dir)
    one = store.owned(docs, "org-1", "document_id", F.lit(4)).select(F.lit("document").alias("what"), F.col("document_id").alias("id"))
    many = store.owned_children(concepts(spark, sf_dir), docs, "org-1", "document_id").select(F.lit("concept").alias("what"), "id")
    return one.unionByName(many)


def listed_documents(spark, sf_dir):
    return store.listed(documents(spark, sf_dir), newest="updated_at", tie="document_id", org_id="org-2", status="REVIEW", processing=None).select("document_id", "status")


def concept_update(spark, sf_dir):
    """Changes that say which columns they set: a named null empties, an unnamed one says nothing."""
    c = concepts(spark, sf_dir).select("id", "confidence", "action")
    changes = c.where("id % 3 = 0").select("id", F.lit(None).cast("double").alias("confidence"), F.lit("BLOCK").alias("action"), F.when(F.col("id") % 2 == 0, F.array(F.lit("confidence"))).otherwise(F.array(F.lit("action"))).alias("fields"))
    return store.updated(c, changes, "id", "fields")


def examples_replaced(spark, sf_dir):
    c = concepts(spark, sf_dir)
    old = c.select("concept_key", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("text"))
    new = c.where("id % 4 = 0").select("concept_key", F.lit("new").alias("text"))
    return store.replaced_examples(old, new)


def created_concepts(spark, sf_dir):
    """New concepts with nested examples, as three tables; their rows by concept."""
    c = concepts(spark, sf_dir).select("concept_key", "source_quote", F.array(F.lit("p1"), F.lit("p2")).alias("positive_examples"), F.array("source_quote").alias("negative_examples"), F.when(F.col("id") % 2 == 0, F.array(F.lit("other"), F.col("source_quote"))).alias("sources"))
    _, examples, sources = store.created(c)
    n = lambda df, name: df.groupBy("concept_key").agg(F.count("*").alias(name))
    return n(examples, "n_examples").join(n(sources, "n_sources"), "concept_key").join(sources.where("ordinal = 0").select("concept_key", "quote_hash"), "concept_key")


def rule_scope(spark, sf_dir):
    return store.scoped_rules(policy_rules(spark, sf_dir), 7).select("id", "is_active")


def rules_in_step(spark, sf_dir):
    return store.in_step(policy_rules(spark, sf_dir)).select("id", "is_active")


def rule_reviews(spark, sf_dir):
    told = policy_rules(spark, sf_dir).withColumn("verdict", F.when(F.col("id") % 2 == 0, "ACCEPT").when(F.col("id") % 5 == 0, "LATER").otherwise("REJECT"))
    return told.select("id", "status", "verdict", rules.reviewed(F.col("status"), F.col("verdict")).alias("after"))


def extraction_reset(spark, sf_dir):
    """How many rows a document's reset removes, and how many stay."""
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("document_id"))
    c = concepts(spark, sf_dir).withColumn("document_id", F.col("document_id") % 100)
    left, gone = store.extraction_reset(chunks, policy_rules(spark, sf_dir), chunks, c, 7)
    stay = {f"{name}_left": df.agg(F.count("*").alias(f"{name}_left")) for name, df in left.items()}
    for df in stay.values():
        gone = gone.crossJoin(df)  # one row each
    return gone


def activation_gate(spark, sf_dir):
    c = concepts(spark, sf_dir)
    index = c.where("id % 50 <> 0").select("concept_key")
    return store.may_activate(documents(spark, sf_dir), c, index)


def review_lists(spark, sf_dir):
    """The first 50 concepts of each of the review list's three orders."""
    c = concepts(spark, sf_dir)
    parts = [store.review_order(c, by).limit(50).select(F.lit(by).alias("by"), "id") for by in ("risk", "confidence", "newest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fresh_chunks(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("text_hash"))
    new = table(spark, sf_dir, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("text_hash"), F.col("c_custkey").alias("id"))
    return store.fresh_only(new, old).select("id")


def null_references(spark, sf_dir):
    gone = documents(spark, sf_dir).where("status = 'ARCHIVED'")
    return store.set_null(concepts(spark, sf_dir).select("id", "document_id"), gone, "document_id")


def cascade_delete(spark, sf_dir):
    docs, c = documents(spark, sf_dir), concepts(spark, sf_dir)
    left = store.cascade(docs, {"concepts": c, "rules": policy_rules(spark, sf_dir)}, docs.where("processing = 'PENDING'"), "document_id")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def live_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return store.live_sessions(sessions, F.lit(NOW).cast("timestamp")).select("event_id")


def audit_trail(spark, sf_dir):
    """Audit rows whose long notes give way to their length."""
    events = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("text"), F.col("text")).alias("metadata"), F.lit(NOW).cast("timestamp").alias("created_at"))
    told = logs.audit_rows(events)
    return told.select("doc_id", F.col("metadata")["source"].alias("source"), t.sha256(F.col("metadata")["text"]).alias("digest"), F.length(F.col("metadata")["text"]).cast("bigint").alias("n"), "day")


def audit_first_page(spark, sf_dir):
    """The newest 500 audit rows at most: a page is a limit."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return store.audit_page(events, 1000).select("id")


def decision_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "ALLOW").alias("action"), F.when(F.col("event_type") == "error", "high").alias("risk"), F.col("ts").alias("created_at"))
    return logs.decision_rows(e).select("event_id", "action", "risk", "route", "score", "external_used", F.col("n_masked").cast("bigint").alias("n_masked"), "day")


def mask_dictionary(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("org-"), (F.col("n_regionkey") % 2).cast("string")).alias("org_id"), _of(_KINDS, F.col("n_nationkey") % 3).alias("kind"), F.col("n_name").alias("term"), (F.col("n_nationkey") % 5 != 0).alias("is_active"))
    return store.mask_terms(n, "org-1").select("kind", F.array_join("terms", ",").alias("terms"))


def stored_lists(spark, sf_dir):
    """Stored JSON lists, some of them unreadable; and stored lists of records."""
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "not json").when(k % 5 == 1, F.lit(None).cast("string")).otherwise(F.to_json(F.split("p_name", " ")))
    records = F.when(k % 3 == 0, "{").otherwise(F.to_json(F.array(F.struct(F.col("p_size").alias("n"), F.col("p_brand").alias("s")))))
    read = table(spark, sf_dir, "part").select(k.alias("id"), store.json_list(raw).alias("words"), store.json_table(records, "struct<n: bigint, s: string>").alias("rows"))
    return read.select("id", F.array_join("words", "|").alias("words"), F.size("rows").cast("bigint").alias("n_rows"), F.get("rows", F.lit(0))["s"].alias("brand"))


def policy_snapshot(spark, sf_dir):
    """An organisation's running rules, and the restricted chunks of its active documents."""
    r = policy_rules(spark, sf_dir).withColumn("org_id", F.concat(F.lit("org-"), (F.col("id") % 3).cast("string")))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderstatus") == "F").alias("is_restricted"))
    own, restricted = store.snapshot(documents(spark, sf_dir), r, chunks, "org-1")
    return own.select(F.lit("rule").alias("what"), "id").unionByName(restricted.select(F.lit("chunk").alias("what"), F.col("ordinal").alias("id")))


def units_with_concepts(spark, sf_dir):
    """Units (customers) with their concepts (orders) and each concept's sources (lines) nested."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    c = store.nested(concepts(spark, sf_dir).select("id", "document_id"), {"sources": (lines, "l_linenumber")}, "id")
    units = store.nested(documents(spark, sf_dir).select("document_id"), {"concepts": (c, "id")}, "document_id")
    total = F.aggregate("concepts", F.lit(0), lambda a, x: a + F.size(x["sources"]))
    return units.select("document_id", F.size("concepts").cast("bigint").alias("n_concepts"), total.cast("bigint").alias("n_sources"))


def rule_identities(spark, sf_dir):
    hashed = rules.identity_hash(F.col("title"), F.col("detector_type"), F.col("regex_source"), F.col("checksum_kind"), F.col("keywords"))
    return policy_rules(spark, sf_dir).select("id", hashed.alias("identity_hash"))


def strictest_rules(spark, sf_dir):
    """The hundred strictest rules."""
    return rules.strictest_first(policy_rules(spark, sf_dir)).limit(100).select("id")


def state_moves(spark, sf_dir):
    """Every pair of a document's states; reads no table but regions, five rows for five old states."""
    told = table(spark, sf_dir, "region").select(_of([*_STATES, "OTHER"], F.col("r_regionkey")).alias("old")).withColumn("new", F.explode(F.array(*(F.lit(s) for s in _STATES))))
    return told.select("old", "new", rules.can_move(F.col("old"), F.col("new")).alias("allowed"))


def compiled_policy(spark, sf_dir):
    return rules.compiled(policy_rules(spark, sf_dir)).select("id", "skip_reason")


def rule_concepts(spark, sf_dir):
    have = policy_rules(spark, sf_dir).where("id % 4 = 1").select(F.concat(F.lit("r_"), F.col("id").cast("string")).alias("concept_key"))
    return store.concept_from_rule(policy_rules(spark, sf_dir), have).select("concept_key", "action", "sensitivity", "review_status")


def _rule_text():
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, "is BLOCKED here").when(k % 4 == 1, "is LOCAL_ONLY, that is ROUTE_LOCAL").when(k % 4 == 2, "is ALLOW_EXTERNAL or BLOCK").otherwise("has no action")
    return F.concat(F.lit("Rule AB-"), k.cast("string"), F.lit(": "), F.col("p_name"), F.lit("\n"), F.col("p_type"), F.lit(" "), said, F.lit(". Except samples."))


def explicit_rules(spark, sf_dir):
    told = table(spark, sf_dir, "part").select("p_partkey", ingestion.explicit_rule(_rule_text()).alias("r")).where("r IS NOT NULL")
    return told.select("p_partkey", "r.concept_key", "r.name_fa", "r.action", "r.sensitivity", F.array_join("r.conditions", "|").alias("conditions"))


_HEAD, _KEEP = "قاعده", "محتوای این بخش نباید بیرون رود"


def structured_policy(spark, sf_dir):
    """A policy document of three headed rules for each supplier, read back; the third names no action."""
    k = F.col("s_suppkey").cast("string")
    rule = lambda code, n, body: F.concat(F.lit(f"{_HEAD} {code}-{n} ـ "), F.lit("عنوان "), k, F.lit("\n"), F.lit(f"{_KEEP} "), k, F.lit(f" {body}\n"))
    full = F.concat(rule("SEC", "001", "BLOCKED"), rule("PII", "002", "LOCAL_ONLY"), rule("HR", "003", "-"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), full.alias("full_text"))
    docs = docs.withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(2).alias("page"), F.lit(10).alias("start"), F.lit(100_000).alias("end"))))
    return ingestion.structured_rules(docs).select("document_id", "policy_code", "title", "body", F.col("page").cast("bigint").alias("page"), "severity", "category")


def quotes_checked(spark, sf_dir):
    """Quotes cut out of documents, as they are or in capitals, some of them of another document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.substring(t.strip(F.col("text")), 1, 60)
    quote = F.when(F.col("doc_id") % 3 == 0, cut).when(F.col("doc_id") % 3 == 1, F.translate(cut, _SMALL, _SMALL.upper())).otherwise("zq zz qx")
    return ingestion.with_how(d.withColumn("quote", quote), "quote", "text").select("doc_id", "how")


def provenance(spark, sf_dir):
    """Concepts whose quotes are checked against their unit; a missing page is the unit's."""
    p = table(spark, sf_dir, "part")
    units = p.select(F.col("p_partkey").alias("unit_id"), F.concat(F.lit("the "), F.col("p_name"), F.lit(" is here. second part")).alias("text"), F.lit(3).alias("page"))
    quote = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("the  "), F.upper("p_name"))).otherwise("nothing like it at all")
    c = p.select(F.col("p_partkey").alias("unit_id"), quote.alias("source_quote"), F.when(F.col("p_partkey") % 2 == 0, 9).alias("source_page"))
    return ingestion.with_provenance(c, units).select("unit_id", "how", "verdict", F.col("source_page").cast("bigint").alias("source_page"))


def model_concepts(spark, sf_dir):
    """A model's answers in JSON, with and without a fence, valid and not."""
    k = F.col("p_partkey")
    concept = F.struct(
        F.concat(F.lit("k"), k.cast("string")).alias("conceptKey"), F.col("p_name").alias("name"), F.col("p_brand").alias("sourceQuote"),
        F.when(k % 5 == 0, "SECRET").otherwise("PUBLIC").alias("sensitivity"), F.when(k % 3 == 0, "BLOCK").otherwise("ALLOW_EXTERNAL").alias("action"), ((k % 15) / 10).alias("confidence"),
    )
    listed = F.to_json(F.array(concept))
    raw = F.when(k % 4 == 0, "no answer").when(k % 4 == 1, F.concat(F.lit("<think>[1]</think>```json\n"), listed, F.lit("\n```"))).otherwise(F.concat(F.lit("so: "), listed))
    told = table(spark, sf_dir, "part").select("p_partkey", F.explode(ingestion.extracted_concepts(raw)).alias("c"))
    return told.select("p_partkey", "c.concept.conceptKey", F.array_join("c.errors", "|").alias("errors"), F.array_join("c.flags", "|").alias("flags"))


def merged_sources(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), (F.col("o_orderkey") % 100).cast("string")).alias("concept_key"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("source_quote"))
    kept, sources = ingestion.merged_concepts(c)
    return kept.select("concept_key", "ordinal").join(sources.groupBy("concept_key").agg(F.count("*").alias("n_sources")), "concept_key")


def legacy_answers(spark, sf_dir):
    k = F.col("p_partkey")
    risk = _of(["low", "HIGH", "medium", "unheard", "critical"], k % 5)
    raw = F.concat(F.lit("here: "), F.to_json(F.struct((k % 2 == 0).alias("is_sensitive"), F.when(k % 3 == 0, "personal_data").otherwise("odd").alias("category"), risk.alias("risk_level"), F.col("p_name").alias("reason"))))
    told = table(spark, sf_dir, "part").select("p_partkey", decide.parsed_legacy(raw).alias("a"))
    return told.select("p_partkey", F.col("a").isNotNull().alias("ok"), "a.is_sensitive", "a.category", "a.risk_level", "a.reason")


def classified_hits(spark, sf_dir):
    """Each order's lines as hits, their discounts and quantities as confidences."""
    hit = F.struct((F.col("l_quantity") / 60).alias("confidence"), F.col("l_returnflag").alias("category"), F.lit(None).cast("string").alias("rule_id"), F.concat(F.lit("line "), F.col("l_returnflag")).alias("label"))
    told = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(hit).alias("hits"))
    out = decide.classify(F.col("hits"), F.col("l_orderkey") % 11 == 0)
    return told.select("l_orderkey", out.alias("o"), F.array_join(F.array_sort(decide.labels(F.col("hits"))), ",").alias("labels")).select("l_orderkey", "o.decision", "o.action", F.size("o.hits").cast("bigint").alias("n_hits"), "labels")


def reviewed_examples(spark, sf_dir):
    """Conversations of one user message that equals a concept's example; here each conversation's first message alone."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "role", "text")
    examples = c.where("role = 'user'").select(
        F.concat(F.lit("k"), (F.col("conv_id") % 10).cast("string")).alias("concept_key"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.translate("text", _SMALL, _SMALL.upper()))).otherwise(F.array().cast("array<string>")).alias("positive_examples"),
        F.when(F.col("conv_id") % 3 == 0, F.array(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("negative_examples"),
    )
    return decide.reviewed_example(c, examples)


def layered_engine(spark, sf_dir):
    """Parts' sizes as the scores of three layers; some layers fail, some end the run."""
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.when(k % 13 != 0, F.when(size > 45, 1.0).otherwise(0.0))
    layers = [(first, size > 45), (F.when(k % 5 == 0, 0.8).otherwise(0.0), F.lit(False)), (F.when(k % 7 != 0, 0.0), F.lit(False))]
    told = table(spark, sf_dir, "part").select("p_partkey", decide.first_engine(layers).alias("e"))
    return told.select("p_partkey", "e.action", "e.score", F.col("e.layers_run").cast("bigint").alias("layers_run"))


def log_fields(spark, sf_dir):
    """Routes, risks and request headers as they are logged."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, _of(["BLOCKED", "LOCAL", "EXTERNAL_DIRECT"], k % 3).alias("route"), _of(decide.RISK, k % 4).alias("risk"))
    forwarded = F.when(k % 5 == 0, F.concat(F.lit(" 10.0.0."), (k % 9).cast("string"), F.lit(" , 10.1.1.1"))).when(k % 5 == 1, "")
    return o.select("o_orderkey", decide.log_fields(F.col("route"), F.col("risk")).alias("f"), decide.source_address(forwarded, F.when(k % 2 == 0, "10.9.9.9")).alias("address"), decide.max_risk(F.col("risk"), F.lit("medium")).alias("at_least")).select("o_orderkey", "f.action", "f.risk", "f.route", "address", "at_least")


def local_notices(spark, sf_dir):
    p = F.col("p_partkey")
    said = decide.notice(F.when(p % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")), F.when(p % 3 == 0, F.col("p_brand")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("notice"))


def policy_readiness(spark, sf_dir):
    """Active documents that are ready, and decisions made under the revision in force or another one."""
    revisions = conversations.policy_revision(concepts(spark, sf_dir), documents(spark, sf_dir))
    decisions = revisions.select("document_id", F.when(F.col("document_id") % 8 == 2, "older").otherwise(F.col("revision")).alias("revision"))
    return conversations.still_current(decisions, revisions).select("document_id", "current").join(revisions.select("document_id", "ready"), "document_id")


def closed_requests(spark, sf_dir):
    """Every request has a decision; where none was made it is closed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    made = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("EXTERNAL_DIRECT").alias("route"), F.lit("SAFE").alias("decision"), F.lit("EXTERNAL_ALLOWED").alias("action"), F.lit("HEALTHY").alias("health"))
    return decide.closed_where_missing(made, o, "o_orderkey")


def route_passes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "LOCAL").otherwise("EXTERNAL").alias("route"), F.when(F.col("value") > 20, "LOCAL").otherwise("EXTERNAL").alias("expected"))
    return evaluation.pass_counts(e)


def repair_totals(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("swapped"), F.col("l_linenumber").alias("glued"), F.lit(1).alias("junk"), F.lit(None).cast("int").alias("collapsed"))
    return repair.totals(line)


def concept_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    some = F.when(F.col("p_partkey") % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    said = store.embedding_text(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.concat(F.col("p_name"), F.lit("\n\nEND ")), some, none, some)
    return p.select("p_partkey", t.sha256(said).alias("digest"))


def digits_unified(spark, sf_dir):
    """Order numbers written in three scripts, read back."""
    k = F.col("o_orderkey").cast("string")
    script = F.when(F.col("o_orderkey") % 3 == 0, F.translate(k, "0123456789", "۰۱۲۳۴۵۶۷۸۹")).when(F.col("o_orderkey") % 3 == 1, F.translate(k, "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(k)
    return table(spark, sf_dir, "orders").select("o_orderkey", t.ascii_digits(script).alias("digits"), t.char_hygiene(F.concat(script, F.lit("ـــيك"))).alias("clean"))


def corrupted_texts(spark, sf_dir):
    """Names in Latin letters with Persian words of turned pairs beside them."""
    k = F.col("p_partkey")
    said = F.concat(F.col("p_name"), F.when(k % 4 == 0, " کنرتل مشرتی معترب").when(k % 4 == 1, " کنرتل مشرتی").when(k % 4 == 2, " سالم سالم سالم سالم").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", repair.looks_corrupted(said, F.array(F.lit("سالم"))).alias("corrupted"))


def page_lines(spark, sf_dir):
    """Positioned items (order lines) put together to lines and pages."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ordinal")).agg(F.max("l_suppkey").alias("x"), F.max("l_quantity").alias("y"))
    items = items.select("page", "ordinal", F.concat(F.lit("w"), F.col("x").cast("string")).alias("str"), "x", "y", (F.col("ordinal") % 3 == 0).alias("eol"))
    return ingestion.page_lines(items).select("page", "text")


def index_rebuild(spark, sf_dir):
    """Active concepts (vectors) indexed anew; those whose vector can't be used are counted."""
    told = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("concept_key"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding").cast("array<double>")).alias("vector"), F.when(F.col("label") % 2 == 0, "ACTIVE").otherwise("DRAFT").alias("review_status"))
    return scoring.index_counts(scoring.rebuilt_index(told, 64))


QUERIES = {
    f.__name__: f
    for f in (
        document_activation, lifecycle_stamps, owned_concepts, listed_documents, concept_update, examples_replaced, created_concepts, rule_scope, rules_in_step,
        rule_reviews, extraction_reset, activation_gate, review_lists, fresh_chunks, null_references, cascade_delete, live_sessions, audit_trail, audit_first_page,
        decision_rows, mask_dictionary, stored_lists, policy_snapshot, units_with_concepts, rule_identities, strictest_rules, state_moves, compiled_policy, rule_concepts,
        explicit_rules, structured_policy, quotes_checked, provenance, model_concepts, merged_sources, legacy_answers, classified_hits, reviewed_examples, layered_engine,
        log_fields, local_notices, policy_readiness, closed_requests, route_passes, repair_totals, concept_texts, digits_unified, corrupted_texts, page_lines, index_rebuild,
    )
}

_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_DOCS = f"""d AS (SELECT c_custkey AS document_id, 'org-' || c_nationkey % 3 AS org_id, {_list(_STATES)}[c_custkey % 4 + 1] AS status,
  CASE WHEN c_acctbal > 0 THEN 'READY' ELSE 'PENDING' END AS processing FROM customer)"""
_CONCEPTS = f"""c AS (SELECT o_orderkey AS id, o_custkey AS document_id, 'k' || o_orderkey AS concept_key, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'DRAFT' ELSE 'REVIEW' END AS review_status,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100 END AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS flags, o_orderpriority AS source_quote, o_orderdate AS created_at,
  {_list(decide.ACTION)}[o_orderkey % 4 + 1] AS action FROM orders)"""
_RULES = f"""r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 100 END AS document_id, CASE WHEN p_partkey % 3 = 0 THEN 'MANUAL' ELSE 'AUTO' END AS origin,
  {_list(_REVIEW)}[p_size % 5 + 1] AS status, p_partkey % 2 = 0 AS is_active, {_list(_SEVERITIES)}[p_partkey % 4 + 1] AS severity, {_list(_ACTIONS)}[p_partkey % 3 + 1] AS action, p_name AS title,
  ['REGEX', 'SEMANTIC', 'CHECKSUM'][p_partkey % 3 + 1] AS detector_type, CASE WHEN p_partkey % 6 = 0 THEN '([unclosed' WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS regex_source,
  CASE WHEN p_partkey % 4 = 0 THEN 'IBAN' END AS checksum_kind, p_size % 7 AS priority, p_size % 3 AS scope_size FROM part)"""
_FA = "'۰۱۲۳۴۵۶۷۸۹'"

ORACLE_SQL = {
    "document_activation": f"WITH {_DOCS}, y AS (SELECT count(*) AS n FROM d WHERE document_id = 1 AND org_id = 'org-1') SELECT document_id, org_id, CASE WHEN n = 0 OR org_id <> 'org-1' THEN status WHEN document_id = 1 THEN 'ACTIVE' WHEN status = 'ACTIVE' THEN 'ARCHIVED' ELSE status END AS status FROM d, y",
    "lifecycle_stamps": f"WITH {_DOCS}, n AS (SELECT document_id, status AS old, CASE document_id % 8 WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'ARCHIVED' ELSE status END AS status FROM d) SELECT document_id, status, status <> old AS touched, status <> old AND status = 'ACTIVE' AS activated, status <> old AND status = 'ARCHIVED' AS archived FROM n",
    "owned_concepts": f"WITH {_DOCS}, {_CONCEPTS} SELECT 'document' AS what, document_id AS id FROM d WHERE document_id = 4 AND org_id = 'org-1' UNION ALL SELECT 'concept', id FROM c WHERE document_id IN (SELECT document_id FROM d WHERE org_id = 'org-1')",
    "listed_documents": f"WITH {_DOCS} SELECT document_id, status FROM d WHERE org_id = 'org-2' AND status = 'REVIEW'",
    "concept_update": f"WITH {_CONCEPTS} SELECT id, CASE WHEN id % 6 <> 0 THEN confidence END AS confidence, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'BLOCK' ELSE action END AS action FROM c",
    "examples_replaced": f"WITH {_CONCEPTS} SELECT concept_key, unnest(CASE WHEN id % 4 = 0 THEN ['new'] ELSE ['a', 'b'] END) AS text FROM c",
    "created_concepts": f"WITH {_CONCEPTS} SELECT concept_key, 3 AS n_examples, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n_sources, sha256(source_quote) AS quote_hash FROM c".replace("3 AS n", "CAST(3 AS BIGINT) AS n").replace("CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END", "CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT)"),
    "rule_scope": f"WITH {_RULES} SELECT id, CASE WHEN origin = 'AUTO' AND coalesce(document_id <> 7, true) THEN false WHEN document_id = 7 AND status = 'ACTIVE' THEN true ELSE is_active END AS is_active FROM r",
    "rules_in_step": f"WITH {_RULES} SELECT id, status = 'ACTIVE' AS is_active FROM r",
    "rule_reviews": f"WITH {_RULES}, v AS (SELECT id, status, CASE WHEN id % 2 = 0 THEN 'ACCEPT' WHEN id % 5 = 0 THEN 'LATER' ELSE 'REJECT' END AS verdict FROM r) SELECT id, status, verdict, CASE WHEN status IN ('DRAFT', 'PENDING_LLM', 'REVIEW') THEN CASE verdict WHEN 'ACCEPT' THEN 'ACTIVE' WHEN 'REJECT' THEN 'REJECTED' END END AS after FROM v",
    "extraction_reset": f"""WITH {_CONCEPTS}, {_RULES}, k AS (SELECT l_orderkey % 100 = 7 AS own FROM lineitem), p AS (SELECT coalesce(document_id = 7, false) AND origin = 'AUTO' AS own FROM r), q AS (SELECT document_id % 100 = 7 AND review_status IN ('DRAFT', 'REVIEW') AS own FROM c)
SELECT (SELECT count_if(own) FROM k) AS chunks, (SELECT count_if(own) FROM p) AS rules, (SELECT count_if(own) FROM k) AS units, (SELECT count_if(own) FROM q) AS concepts,
  (SELECT count_if(NOT own) FROM k) AS chunks_left, (SELECT count_if(NOT own) FROM p) AS rules_left, (SELECT count_if(NOT own) FROM k) AS units_left, (SELECT count_if(NOT own) FROM q) AS concepts_left""",
    "activation_gate": f"""WITH {_DOCS}, {_CONCEPTS}, s AS (SELECT document_id, count_if(review_status = 'ACTIVE') AS a, count_if(review_status <> 'ACTIVE') AS w, count_if(review_status = 'ACTIVE' AND id % 50 <> 0) AS i FROM c GROUP BY 1)
SELECT document_id, processing = 'READY' AND status = 'REVIEW' AND coalesce(a, 0) > 0 AND coalesce(w, 0) = 0 AND coalesce(i, 0) = coalesce(a, 0) AS may_activate, coalesce(a, 0) AS n_active, coalesce(w, 0) AS n_waiting, coalesce(i, 0) AS n_indexed FROM d LEFT JOIN s USING (document_id)""",
    "review_lists": f"""WITH {_CONCEPTS} (SELECT 'risk' AS "by", id FROM c ORDER BY flags DESC, coalesce(confidence, 0.8), length(source_quote) DESC, id LIMIT 50)
UNION ALL (SELECT 'confidence', id FROM c ORDER BY coalesce(confidence, 0.8), id LIMIT 50) UNION ALL (SELECT 'newest', id FROM c ORDER BY created_at DESC, id LIMIT 50)""",
    "fresh_chunks": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
    "null_references": f"WITH {_DOCS}, {_CONCEPTS} SELECT id, CASE WHEN document_id NOT IN (SELECT document_id FROM d WHERE status = 'ARCHIVED') THEN document_id END AS document_id FROM c",
    "cascade_delete": f"""WITH {_DOCS}, {_CONCEPTS}, {_RULES}, g AS (SELECT document_id FROM d WHERE processing = 'PENDING')
SELECT 'parent' AS what, count(*) AS n FROM d WHERE document_id NOT IN (FROM g) UNION ALL SELECT 'concepts', count(*) FROM c WHERE document_id NOT IN (FROM g) UNION ALL SELECT 'rules', count(*) FROM r WHERE document_id IS NULL OR document_id NOT IN (FROM g)""",
    "live_sessions": f"SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '{NOW}'",
    "audit_trail": """WITH m AS (SELECT doc_id, source, CASE WHEN length(text) > 300 THEN '{"truncated":true,"length":' || length(text) || '}' ELSE text END AS x FROM documents) SELECT doc_id, source, sha256(x) AS digest, length(x) AS n, DATE '2024-01-15' AS day FROM m""",
    "audit_first_page": "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "decision_rows": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'ALLOW' ELSE 'BLOCK' END AS action, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS risk, 'LOCAL' AS route, 0.0::DOUBLE AS score, false AS external_used, 0::BIGINT AS n_masked, CAST(ts AS DATE) AS day FROM events",
    "mask_dictionary": f"SELECT {_list(_KINDS)}[n_nationkey % 3 + 1] AS kind, string_agg(n_name, ',' ORDER BY n_name) AS terms FROM nation WHERE n_regionkey % 2 = 1 AND n_nationkey % 5 <> 0 GROUP BY 1",
    "stored_lists": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 2 THEN '' ELSE replace(p_name, ' ', '|') END AS words, CAST(p_partkey % 3 <> 0 AS BIGINT) AS n_rows, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand FROM part",
    "policy_snapshot": f"WITH {_DOCS} SELECT 'rule' AS what, p_partkey AS id FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0 UNION ALL SELECT 'chunk', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT document_id FROM d WHERE org_id = 'org-1' AND status = 'ACTIVE')",
    "units_with_concepts": "SELECT c_custkey AS document_id, count(DISTINCT o_orderkey) AS n_concepts, count(l_orderkey) AS n_sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "rule_identities": f"WITH {_RULES} SELECT id, sha256(concat_ws('§', regexp_replace(lower(title), '\\s+', '_', 'g'), detector_type, CASE WHEN detector_type = 'REGEX' THEN regex_source ELSE '' END, coalesce(checksum_kind, ''), lower(replace(title, ' ', '|')))) AS identity_hash FROM r",
    "strictest_rules": f"WITH {_RULES} SELECT id FROM r ORDER BY CASE action WHEN 'BLOCK_EXTERNAL' THEN 3 WHEN 'MASK' THEN 2 ELSE 1 END DESC, scope_size, priority, id LIMIT 100",
    "state_moves": f"SELECT o AS old, n AS new, o || '>' || n IN ('DRAFT>REVIEW', 'DRAFT>ARCHIVED', 'REVIEW>ACTIVE', 'REVIEW>DRAFT', 'ACTIVE>ARCHIVED') AS allowed FROM (SELECT unnest({_list([*_STATES, 'OTHER'])}) AS o), (SELECT unnest({_list(_STATES)}) AS n)",
    "compiled_policy": f"""WITH {_RULES} SELECT id, CASE WHEN detector_type = 'REGEX' AND regex_source = '' THEN 'REGEX rule missing source' WHEN detector_type = 'REGEX' AND starts_with(regex_source, '([') THEN 'invalid regex source'
  WHEN detector_type = 'CHECKSUM' AND checksum_kind IS NULL THEN 'CHECKSUM rule missing kind' END AS skip_reason FROM r""",
    "rule_concepts": f"""WITH {_RULES} SELECT 'r_' || id AS concept_key, CASE action WHEN 'MASK' THEN 'MASK_AND_ALLOW_EXTERNAL' ELSE 'ROUTE_LOCAL' END AS action,
  CASE severity WHEN 'CRITICAL' THEN 'HIGHLY_CONFIDENTIAL' WHEN 'HIGH' THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END AS sensitivity, 'REVIEW' AS review_status FROM r WHERE detector_type = 'SEMANTIC' AND id % 4 <> 1""",
    "explicit_rules": "SELECT p_partkey, 'ab_' || p_partkey AS concept_key, p_name AS name_fa, CASE WHEN p_partkey % 4 = 0 THEN 'BLOCK' ELSE 'ROUTE_LOCAL' END AS action, 'CONFIDENTIAL' AS sensitivity, 'Except samples.' AS conditions FROM part WHERE p_partkey % 4 < 2",
    "structured_policy": f"""SELECT s_suppkey AS document_id, x.code AS policy_code, '{_HEAD} ' || x.code || ' ـ عنوان ' || s_suppkey AS title, '{_KEEP} ' || s_suppkey || ' ' || x.act AS body, x.page AS page, x.sev AS severity, x.cat AS category
FROM supplier, (SELECT unnest([{{'code': 'SEC-001', 'act': 'BLOCKED', 'page': 1::BIGINT, 'sev': 'CRITICAL', 'cat': 'امنیت'}}, {{'code': 'PII-002', 'act': 'LOCAL_ONLY', 'page': 2::BIGINT, 'sev': 'HIGH', 'cat': 'داده‌های شخصی'}}]) AS x)""",
    "quotes_checked": """WITH q AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, s, CASE doc_id % 3 WHEN 0 THEN s[1:60] WHEN 1 THEN translate(s[1:60], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE 'zq zz qx' END AS g FROM q),
b AS (SELECT doc_id, s, regexp_replace(regexp_replace(regexp_replace(g, '^\\s+|\\s+$', '', 'g'), '^[«"'']+|[»"'']+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS g FROM p)
SELECT doc_id, CASE WHEN g = '' OR s = '' THEN NULL WHEN contains(s, g) THEN 'exact' WHEN contains(lower(regexp_replace(s, '\\s+', ' ', 'g')), lower(regexp_replace(g, '\\s+', ' ', 'g'))) THEN 'normalized' END AS how FROM b""",
    "provenance": "SELECT p_partkey AS unit_id, ['exact', 'normalized', NULL][p_partkey % 3 + 1] AS how, CASE WHEN p_partkey % 3 = 2 THEN 'REJECTED' ELSE 'ACCEPTED' END AS verdict, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 3 END::BIGINT AS source_page FROM part",
    "model_concepts": """SELECT p_partkey, 'k' || p_partkey AS "conceptKey", concat_ws('|', CASE WHEN p_partkey % 5 = 0 THEN 'sensitivity unknown' END, CASE WHEN p_partkey % 15 > 10 THEN 'confidence out of range' END) AS errors,
  CASE WHEN (p_partkey % 5 <> 0) = (p_partkey % 3 = 0) THEN 'SENSITIVITY_ACTION_MISMATCH' ELSE '' END AS flags FROM part WHERE p_partkey % 4 <> 0""",
    "merged_sources": "SELECT 'k' || o_orderkey % 100 AS concept_key, min(o_orderkey) AS ordinal, count(DISTINCT o_orderpriority) AS n_sources FROM orders GROUP BY 1",
    "legacy_answers": """WITH a AS (SELECT p_partkey, p_partkey % 5 <> 3 AS ok, ['low', 'high', 'medium', 'unheard', 'critical'][p_partkey % 5 + 1] AS risk, p_name FROM part)
SELECT p_partkey, ok, CASE WHEN ok THEN p_partkey % 2 = 0 OR risk <> 'low' END AS is_sensitive, CASE WHEN ok THEN CASE WHEN p_partkey % 3 = 0 THEN 'personal_data' ELSE 'general' END END AS category, CASE WHEN ok THEN risk END AS risk_level, CASE WHEN ok THEN p_name END AS reason FROM a""",
    "classified_hits": """WITH h AS (SELECT l_orderkey, max(l_quantity / 60) AS most, count_if(l_quantity / 60 >= 0.5) AS n, string_agg(DISTINCT 'line ' || l_returnflag, ',' ORDER BY 'line ' || l_returnflag) AS labels FROM lineitem GROUP BY 1),
d AS (SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN 'UNCERTAIN' WHEN n = 0 THEN 'SAFE' WHEN most >= 0.85 THEN 'SENSITIVE' ELSE 'UNCERTAIN' END AS decision FROM h)
SELECT l_orderkey, decision, CASE WHEN decision = 'SAFE' THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS action, n AS n_hits, labels FROM d""",
    "reviewed_examples": """WITH u AS (SELECT conv_id, lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM conversations WHERE turn = 0 AND role = 'user'),
e AS (SELECT 'k' || conv_id % 10 AS concept_key, h, true AS a FROM u WHERE conv_id % 2 = 0 UNION SELECT 'k' || conv_id % 10, h, false FROM u WHERE conv_id % 3 = 0)
SELECT conv_id, concept_key, bool_or(a) AS applies FROM u JOIN e USING (h) GROUP BY ALL HAVING count(DISTINCT a) = 1""",
    "layered_engine": """WITH l AS (SELECT p_partkey, p_partkey % 13 = 0 AS f1, p_size > 45 AS stop, p_partkey % 5 = 0 AS hit, p_partkey % 7 = 0 AS f3 FROM part),
s AS (SELECT *, f1 OR (NOT stop AND f3) AS failed, CASE WHEN stop AND NOT f1 THEN 1.0 WHEN NOT stop AND hit THEN 0.8 ELSE 0.0 END AS score FROM l)
SELECT p_partkey, CASE WHEN failed OR score > 0 THEN 'BLOCK' ELSE 'ALLOW' END AS action, CASE WHEN failed THEN 1.0 ELSE score END::DOUBLE AS score, CASE WHEN stop THEN 1 ELSE 3 END::BIGINT AS layers_run FROM s""",
    "log_fields": """WITH o AS (SELECT o_orderkey AS k, ['BLOCKED', 'LOCAL', 'EXTERNAL_DIRECT'][o_orderkey % 3 + 1] AS route, ['low', 'medium', 'high', 'critical'][o_orderkey % 4 + 1] AS risk FROM orders)
SELECT k AS o_orderkey, CASE WHEN route = 'BLOCKED' THEN 'BLOCK' ELSE 'ALLOW' END AS action, CASE route WHEN 'BLOCKED' THEN 'critical' WHEN 'LOCAL' THEN CASE WHEN risk IN ('high', 'critical') THEN 'high' ELSE 'medium' END ELSE 'low' END AS risk, route,
  CASE WHEN k % 5 = 0 THEN '10.0.0.' || k % 9 WHEN k % 2 = 0 THEN '10.9.9.9' ELSE 'unknown' END AS address, CASE WHEN risk IN ('high', 'critical') THEN risk ELSE 'medium' END AS at_least FROM o""",
    "local_notices": "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN 'labels: ' || replace(p_name, ' ', ', ') END, CASE WHEN p_partkey % 3 = 0 THEN 'reason: ' || p_brand END) AS notice FROM part",
    "policy_readiness": f"""WITH {_DOCS}, {_CONCEPTS}, s AS (SELECT document_id, count_if(review_status = 'ACTIVE') > 0 AND count_if(review_status <> 'ACTIVE') = 0 AS ok FROM c GROUP BY 1)
SELECT document_id, coalesce(ok, false) AS ready, coalesce(ok, false) AND document_id % 8 <> 2 AS current FROM d LEFT JOIN s USING (document_id) WHERE status = 'ACTIVE'""",
    "closed_requests": "SELECT o_orderkey, CASE WHEN x THEN 'EXTERNAL_DIRECT' ELSE 'LOCAL' END AS route, CASE WHEN x THEN 'SAFE' ELSE 'UNCERTAIN' END AS decision, CASE WHEN x THEN 'EXTERNAL_ALLOWED' ELSE 'LOCAL_ONLY' END AS action, CASE WHEN x THEN 'HEALTHY' ELSE 'FAILED' END AS health FROM (SELECT o_orderkey, o_orderkey % 3 <> 0 AS x FROM orders)",
    "route_passes": "SELECT count_if((event_type = 'error') = (value > 20)) AS passed, count(*) AS total FROM events",
    "repair_totals": "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS swapped, CAST(sum(l_linenumber) AS BIGINT) AS glued, count(*) AS junk, 0::BIGINT AS collapsed FROM lineitem",
    "concept_texts": """WITH s AS (SELECT p_partkey, 'مفهوم: ' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END || ' (' || p_brand || ') شرح: ' || p_name || ' end' || CASE WHEN p_partkey % 2 = 0 THEN ' نمونه‌های شمول: - ' || replace(p_name, ' ', ' - ') || ' کلیدواژه‌ها: ' || replace(p_name, ' ', '، ') ELSE '' END AS x FROM part)
SELECT p_partkey, sha256(lower(x)) AS digest FROM s""",
    "digits_unified": f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits, translate(CAST(o_orderkey AS VARCHAR), '0123456789', CASE o_orderkey % 3 WHEN 0 THEN {_FA} WHEN 1 THEN '٠١٢٣٤٥٦٧٨٩' ELSE '0123456789' END) || 'ـیک' AS clean FROM orders",
    "corrupted_texts": "SELECT p_partkey, p_partkey % 4 = 0 AS corrupted FROM part",
    "page_lines": """WITH i AS (SELECT l_orderkey AS page, l_linenumber AS o, max(l_suppkey) AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, coalesce(abs(y - lag(y) OVER w) > 4 OR lag(o % 3 = 0) OVER w, true) AS fresh FROM i WINDOW w AS (PARTITION BY page ORDER BY o)),
l AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY page ORDER BY o) AS line FROM b), j AS (SELECT page, line, string_agg('w' || x, ' ' ORDER BY x DESC, o) AS said FROM l GROUP BY 1, 2)
SELECT page, string_agg(said, chr(10) ORDER BY line) AS text FROM j GROUP BY page""",
    "index_rebuild": "SELECT count_if(vec_id % 9 <> 0) AS indexed, count_if(vec_id % 9 = 0) AS failed FROM embeddings WHERE label % 2 = 0",
}
