"""Processing of policy documents, and of their units into concepts, as restartable jobs with several outputs.

Both read what no committed batch holds yet, write each output under an attempt of
their own and commit all outputs together (see sources.batches). A run that is
killed anywhere and repeated gives the tables of one that wasn't; a run without
anything new does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlake.functions.extractors import SECONDS, Extractor, extracted
from promptlake.functions.patterns import has_any, text_of
from promptlake.functions.text import normalize, sha256
from promptlake.operators import ingestion, rules
from promptlake.operators.numbering import in_groups
from promptlake.session import ship_package
from promptlake.sources.batches import BatchStore

REPORT = (
    "document_id bigint, org_id string, text_hash string, status string, error string, mode string, n_pages bigint, n_chars bigint, n_chunks bigint, n_boilerplate bigint, n_candidates bigint, "
    "n_rules bigint, n_known bigint, n_proposed bigint, n_duplicates bigint, n_conflicts bigint, n_rejected bigint, n_pending bigint"
)
CHUNKS = "document_id bigint, org_id string, ordinal int, span_start int, span_end int, text string, text_hash string, is_boilerplate boolean, is_candidate boolean, page int, is_restricted boolean"
RULES = (
    "document_id bigint, org_id string, code string, title string, body string, keywords array<string>, severity string, category string, detector_type string, checksum_kind string, pattern string, "
    "action string, priority int, status string, page int, text_hash string, conflict_group string, chunk_ordinal int"
)
CONCEPTS = "document_id bigint, concept_key string, name string, sensitivity string, action string, confidence double, review_status string, unit_ordinal int, page int, source_quote string"
SOURCES = "document_id bigint, concept_key string, unit_ordinal int, page int, source_quote string, quote_hash string"
UNITS_DONE = "document_id bigint, unit_hash string, n_concepts bigint, n_rejected bigint"
#: A document with so many structured rules is a structured one.
STRUCTURED = 2


def joined_pages(pages: DataFrame) -> DataFrame:
    """(document_id, org_id, full_text, pages, n_pages, text_hash) of every document, the text null where no page holds any.

    pages: document_id, org_id (one a document), page, text.
    """
    each = pages.groupBy("document_id").agg(F.max("org_id").alias("org_id"), F.count("*").alias("n_pages"))
    told = each.join(ingestion.page_table(pages), "document_id", "left")
    return told.withColumn("text_hash", sha256(F.coalesce("full_text", F.lit(""))))


def _named(rows: DataFrame, keys: list[str]) -> str | None:
    """A name that says which rows a batch holds (their number and the sum of their hashes); None without any."""
    said = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys)).alias("h"), F.sum(F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(1 << 40))).alias("s")).first()
    return f"{said.n}-{said.h & (1 << 64) - 1:016x}-{said.s:x}" if said.n else None


def _deterministic_rules(structured: DataFrame, chunks: DataFrame, fires: DataFrame) -> DataFrame:
    """Rules of structured documents by their headers; of the others by what their chunks (those in `fires`) restrict, number or list."""
    many = structured.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") >= STRUCTURED).select("document_id")
    found = structured.join(many, "document_id", "left_semi").select(
        "document_id", F.lit("structured").alias("mode"), F.row_number().over(Window.partitionBy("document_id").orderBy("policy_code")).alias("at"), "title", "body", "keywords", "severity", "category", "page", "text_hash", F.lit(None).cast("int").alias("chunk_ordinal")
    )
    fires = fires.join(many, "document_id", "left_anti")
    # chunks are numbered without their texts; only those that give a rule bring theirs
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal")) - 1
    solid = chunks.where("NOT is_boilerplate").select("document_id", "ordinal")
    at = solid.join(fires.select("document_id").distinct(), "document_id", "left_semi").withColumn("at", number)
    heuristic = fires.join(at, ["document_id", "ordinal"]).withColumn("r", ingestion.heuristic_rule(F.col("text"), F.col("at"))).where("r IS NOT NULL").select(
        "document_id", F.lit("heuristic").alias("mode"), "at", "r.title", F.col("text").alias("body"), "r.keywords", "r.severity", "r.category", "page", F.lit(None).cast("string").alias("text_hash"), F.col("ordinal").alias("chunk_ordinal")
    )
    return found.unionByName(heuristic)


def process(pages: DataFrame, path: str, extractor: Extractor | None = None, seconds: float = SECONDS, words: list[str] | None = None) -> str | None:
    """Process the documents that the store at `path` doesn't have with this text; the committed batch's name, None if there is nothing new.

    pages: document_id bigint, org_id string, page, text. Outputs: `chunks`, `rules` (found without a model ACTIVE, proposed
    ones DRAFT), `report` (one row a document: READY, or FAILED with its error). A rule that its organisation has already
    isn't added again. An extractor that isn't available, or fails at a chunk, leaves the chunk pending: nothing else is lost.
    """
    spark = ship_package(pages.sparkSession)
    store = BatchStore(spark, path)
    known = store.read("report", REPORT).select("document_id", "text_hash")
    fresh = joined_pages(pages).join(known, ["document_id", "text_hash"], "left_anti")
    attempt = store.begin()
    documents = store.write(attempt, "documents", fresh)
    batch = _named(documents, ["document_id", "text_hash"])
    if batch is None:
        return None
    owner = documents.select("document_id", "org_id")

    cut = ingestion.chunks(documents.where("full_text IS NOT NULL").select("document_id", "org_id", "full_text", "pages"), words=words, beside=("org_id",))
    restricted = has_any(F.col("text"), ingestion.RESTRICTED)
    chunks = store.write(attempt, "chunks", cut.withColumn("is_restricted", restricted).select(*(c.split()[0] for c in CHUNKS.split(", "))))

    structured = store.write(attempt, "structured", ingestion.structured_rules(documents.where("full_text IS NOT NULL")))
    fires = store.write(attempt, "fires", chunks.where("NOT is_boilerplate").where(ingestion.heuristic_fires(F.col("text"))).select("document_id", "ordinal", "text", "page"))
    found = _deterministic_rules(structured, chunks, fires).join(owner, "document_id")
    old = store.read("rules", RULES)
    have = old.where("text_hash IS NOT NULL").select("org_id", "text_hash").distinct().withColumn("known", F.lit(True))
    found = found.join(have, ["org_id", "text_hash"], "left")
    # the first of equal rules within the batch
    firsts = found.where("text_hash IS NOT NULL").groupBy("org_id", "text_hash").agg(F.min(F.struct("document_id", "at")).alias("first"))
    found = found.join(firsts, ["org_id", "text_hash"], "left")
    later = F.col("first").isNotNull() & (F.struct("document_id", "at") != F.col("first"))
    found = found.withColumn("known", F.coalesce("known", F.lit(False)) | F.coalesce(later, F.lit(False))).drop("first")
    found = found.withColumns({"detector_type": F.lit("SEMANTIC"), "action": F.lit("BLOCK_EXTERNAL"), "status": F.lit("ACTIVE"), "priority": F.lit(None).cast("int")})
    found = found.withColumns({"checksum_kind": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "conflict_group": F.lit(None).cast("string"), "verdict": F.when(F.col("known"), "KNOWN").otherwise("ACCEPT"), "rejection": F.lit(None).cast("string")})
    columns = ["document_id", "org_id", "mode", "verdict", "at", *(c for c in (x.split()[0] for x in RULES.split(", ")) if c not in ("document_id", "org_id", "code")), "rejection"]
    every = found.select(*columns)

    reason = extractor.unavailable() if extractor else "no extractor"
    candidates = chunks.where("is_candidate AND NOT is_boilerplate")
    if reason is None:
        told = store.write(attempt, "answers", extracted(candidates.select("document_id", "org_id", "ordinal", "page", "text"), extractor, seconds=seconds))
        each = ingestion.extraction(told.where("error IS NULL"), "answer", "text").where("rule IS NOT NULL OR rejection IS NOT NULL")
        r = "rule."
        identity = rules.identity_hash(F.col(r + "label"), F.col(r + "detectorType"), F.col(r + "regex.source"), F.col(r + "checksumKind"), F.col(r + "keywordsHint"))
        each = each.withColumn("text_hash", F.when(F.col("rejection").isNull(), identity))
        # the columns that stay are made before rows are dealt by document, so no text is shuffled
        each = each.select(
            "document_id", "org_id", F.lit("proposed").alias("mode"), F.col(r + "label").alias("label"), F.substring(F.col(r + "label"), 1, 120).alias("title"), F.coalesce("quote", F.substring("text", 1, 120)).alias("body"),
            F.coalesce(r + "keywordsHint", F.array().cast("array<string>")).alias("keywords"), F.when(F.col(r + "confidence") >= 0.9, "CRITICAL").otherwise("HIGH").alias("severity"), F.col(r + "category").alias("category"),
            F.col(r + "detectorType").alias("detector_type"), F.col(r + "checksumKind").alias("checksum_kind"), F.when(F.col(r + "detectorType") == "REGEX", F.col(r + "regex.source")).alias("pattern"),
            F.col(r + "action").alias("action"), F.col(r + "priority").alias("priority"), F.lit("DRAFT").alias("status"), "page", "text_hash", F.col("ordinal").alias("chunk_ordinal"), "rejection",
        )
        at = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_ordinal", "text_hash", "label", "rejection"))
        proposed = store.write(attempt, "proposed", each.withColumn("at", at).drop("label"))
        good = proposed.where("rejection IS NULL")
        first = good.groupBy("document_id", "text_hash").agg(F.min("at").alias("first"))
        judged = good.join(first, ["document_id", "text_hash"]).withColumn("verdict", F.when(F.col("at") == F.col("first"), "ACCEPT").otherwise("DUPLICATE")).drop("first")
        accepted = judged.where("verdict = 'ACCEPT'").select("document_id", F.col("at").alias("ordinal"), "action", "keywords", F.col("text_hash").alias("identity_hash"))
        groups = rules.conflicts(accepted, within=("document_id",)).withColumnRenamed("ordinal", "at")
        judged = judged.join(groups, ["document_id", "at"], "left")
        refused = proposed.where("rejection IS NOT NULL").withColumns({"verdict": F.lit("REJECTED"), "conflict_group": F.lit(None).cast("string")})
        every = every.unionByName(judged.select(*columns)).unionByName(refused.select(*columns))
        pending = told.join(proposed.select("document_id", F.col("chunk_ordinal").alias("ordinal")).distinct(), ["document_id", "ordinal"], "left_anti")
    else:
        pending = candidates
    judged = store.write(attempt, "judged", every)

    new = in_groups(judged.where("verdict = 'ACCEPT'"), "org_id", ["document_id", "mode", "at"], "number", lambda df: store.write(attempt, "numbered", df))
    highest = old.groupBy("org_id").agg(F.first("org_id").alias("same"), F.max(F.regexp_extract("code", r"\AR-([0-9]+)\z", 1).try_cast("int")).alias("max_code")).drop("same")
    n = (F.coalesce("max_code", F.lit(0)) + F.col("number")).cast("string")
    coded = new.alias("n").join(highest.alias("h"), F.col("n.org_id").eqNullSafe(F.col("h.org_id")), "left").drop(F.col("h.org_id"))
    coded = coded.withColumn("code", F.concat(F.lit("R-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))
    store.write(attempt, "rules", coded.select(*(x.split()[0] for x in RULES.split(", "))))

    count = lambda c, name: F.count_if(c).alias(name)
    own, verdict = F.col("mode") != "proposed", F.col("verdict")
    by_rule = judged.groupBy("document_id").agg(
        F.max(F.when(own, F.col("mode"))).alias("mode"),
        count(own & (verdict == "ACCEPT"), "n_rules"),
        count(own & (verdict == "KNOWN"), "n_known"),
        count(~own & (verdict == "ACCEPT"), "n_proposed"),
        count(verdict == "DUPLICATE", "n_duplicates"),
        count(F.col("conflict_group").isNotNull(), "n_conflicts"),
        count(verdict == "REJECTED", "n_rejected"),
    )
    by_chunk = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), count(F.col("is_boilerplate"), "n_boilerplate"), count(F.col("is_candidate"), "n_candidates"))
    waiting = pending.groupBy("document_id").agg(F.count("*").alias("n_pending"))
    report = documents.join(by_chunk, "document_id", "left").join(by_rule, "document_id", "left").join(waiting, "document_id", "left")
    empty = F.coalesce(F.length("full_text"), F.lit(0)) == 0
    counters = {c: F.coalesce(c, F.lit(0)) for c in (x.split()[0] for x in REPORT.split(", ")) if c.startswith("n_") and c not in ("n_pages", "n_chars")}
    report = report.withColumns({"status": F.when(empty, "FAILED").otherwise("READY"), "error": F.when(empty, "no text"), "mode": F.coalesce("mode", F.lit("none")), "n_chars": F.length(normalize(text_of(F.col("full_text")))).cast("bigint"), **counters})
    store.write(attempt, "report", report.select(*(x.split()[0] for x in REPORT.split(", "))))
    return batch if store.commit(attempt, batch) else None


def audit_entries(report: DataFrame) -> DataFrame:
    """(document_id, org_id, action, metadata): what the audit log says about a processed document."""
    said = lambda action, *names: F.struct(F.lit(action).alias("action"), F.to_json(F.struct(*names)).alias("metadata"))
    entries = F.array(
        said("CHUNKING", "n_pages", "n_chars", "n_chunks"),
        said("RULE_EXTRACT", "mode", "n_rules", "n_known"),
        said("RULE_PROPOSE", "n_candidates", "n_proposed", "n_rejected", "n_duplicates", "n_conflicts", "n_pending"),
    )
    return report.where("status = 'READY'").select("document_id", "org_id", F.explode(entries).alias("e")).select("document_id", "org_id", "e.*")


def ingest_concepts(pages: DataFrame, path: str, extractor: Extractor, seconds: float = SECONDS, words: list[str] | None = None) -> str | None:
    """Draw concepts from the units that the store at `path` hasn't drawn from yet; the batch's name, or None if there is nothing new.

    pages: document_id bigint, page int, text. Outputs: `concepts` (state REVIEW, one a key and document),
    `concept_sources` (every quote of a concept once), `units_done`, `unit_errors`. A unit at which the extractor fails or is late
    is listed with its error and is not done: the next run asks again. Equal texts of one document are asked once.
    """
    spark = ship_package(pages.sparkSession)
    store = BatchStore(spark, path)
    attempt = store.begin()
    wanted = ingestion.units_to_extract(ingestion.units(pages, words=words)).withColumn("unit_hash", sha256(F.col("text")))
    one = wanted.groupBy("document_id", "unit_hash").agg(F.min(F.struct("ordinal", "page", "section_title", "text")).alias("u")).select("document_id", "unit_hash", "u.*")
    done = store.read("units_done", UNITS_DONE).select("document_id", "unit_hash")
    units = store.write(attempt, "units", one.join(done, ["document_id", "unit_hash"], "left_anti"))
    batch = _named(units, ["document_id", "unit_hash"])
    if batch is None:
        return None
    told = store.write(attempt, "answers", extracted(units, extractor, seconds=seconds))
    failed = told.where("error IS NOT NULL").select("document_id", "ordinal", "unit_hash", "error")
    each = told.where("error IS NULL").withColumn("found", ingestion.extracted_concepts(F.col("answer"), F.col("text")))
    usable = F.filter("found", lambda c: F.size(c["errors"]) == 0)
    counted = each.select("document_id", "unit_hash", F.size(usable).cast("bigint").alias("n_concepts"), (F.size("found") - F.size(usable)).cast("bigint").alias("n_rejected"))
    store.write(attempt, "units_done", counted)
    store.write(attempt, "unit_errors", failed)
    rows = each.select("document_id", F.col("ordinal").alias("unit_ordinal"), "page", "section_title", F.posexplode(usable).alias("at", "c"))
    c = "c.concept."
    rows = rows.select("document_id", F.trim(F.col(c + "conceptKey")).alias("concept_key"), F.col(c + "name").alias("name"), F.col(c + "sensitivity").alias("sensitivity"), F.col(c + "action").alias("action"), F.col(c + "confidence").cast("double").alias("confidence"), F.lit("REVIEW").alias("review_status"), "unit_ordinal", F.col("page").cast("int").alias("page"), F.col(c + "sourceQuote").alias("source_quote"), "at")
    rows = store.write(attempt, "found", rows)
    key = ["document_id", "concept_key"]
    columns = lambda schema: [x.split()[0] for x in schema.split(", ")]
    rest = [x for x in columns(CONCEPTS) if x not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct("unit_ordinal", "at", *(x for x in rest if x != "unit_ordinal"))).alias("f"))
    new = first.join(store.read("concepts", CONCEPTS).select(*key), key, "left_anti")
    store.write(attempt, "concepts", new.select(*key, *(F.col(f"f.{x}").alias(x) for x in rest)).select(*columns(CONCEPTS)))
    quoted = rows.withColumn("quote_hash", sha256(F.trim("source_quote")))
    same = [*key, "quote_hash"]
    sources = quoted.groupBy(*same).agg(F.min(F.struct("unit_ordinal", "page", "source_quote")).alias("f"))
    sources = sources.join(store.read("concept_sources", SOURCES).select(*same), same, "left_anti").select(*same, "f.*")
    store.write(attempt, "concept_sources", sources.select(*columns(SOURCES)))
    return batch if store.commit(attempt, batch) else None


def unit_report(path: str, spark) -> DataFrame:
    """(document_id, n_units, n_concepts, n_sources, n_rejected) over all committed batches."""
    store = BatchStore(spark, path)
    done = store.read("units_done", UNITS_DONE).groupBy("document_id").agg(F.count("*").alias("n_units"), F.sum("n_rejected").alias("n_rejected"))
    concepts = store.read("concepts", CONCEPTS).groupBy("document_id").agg(F.count("*").alias("n_concepts"))
    sources = store.read("concept_sources", SOURCES).groupBy("document_id").agg(F.count("*").alias("n_sources"))
    told = done.join(concepts, "document_id", "left").join(sources, "document_id", "left")
    return told.select("document_id", "n_units", F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "n_rejected")


__all__ = ["audit_entries", "ingest_concepts", "joined_pages", "process", "unit_report"]
