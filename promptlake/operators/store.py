"""Policy tables: reads, changes as rewrites, keys and gates. Each function gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_list(text: Column) -> Column:
    """A stored JSON list of texts; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.expr("cast(array() as array<string>)"))


def json_table(text: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.expr(f"cast(array() as array<{kind}>)"))


def nested(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """parents with an array of each child table's rows (empty without any), ordered by the given column.

    Children are gathered by key before the join, so a parent's row is never multiplied.
    """
    out = parents
    for name, (child, order) in children.items():
        others = [c for c in child.columns if c not in (key, order)]
        told = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias(name))
        out = out.join(told, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def examples_by_kind(concepts: DataFrame) -> DataFrame:
    """The examples of a nested concept split into positive and negative ones."""
    of = lambda kind: F.transform(F.filter("examples", lambda e: e["kind"] == kind), lambda e: e["text"])
    return concepts.withColumn("positive_examples", of("POSITIVE")).withColumn("negative_examples", of("NEGATIVE"))


def listed(table: DataFrame, newest: str = "created_at", tie: str = "id", **equal) -> DataFrame:
    """Rows with these values (None: any), newest first."""
    for column, value in equal.items():
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc(newest), tie)


def active_concepts(concepts: DataFrame, documents: DataFrame, document_id: str | None = None) -> DataFrame:
    """Reviewed concepts of one document, or of the active ones."""
    active = concepts.where(F.col("review_status") == "ACTIVE")
    if document_id is not None:
        return active.where(F.col("document_id") == document_id)
    return active.join(documents.where(F.col("status") == "ACTIVE").select("document_id"), "document_id", "left_semi")


def mask_terms(dictionary: DataFrame, org_id: str) -> DataFrame:
    """(kind, terms) of an organisation's active terms."""
    told = dictionary.where((F.col("org_id") == org_id) & F.col("is_active"))
    return told.groupBy("kind").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def created(concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, examples, sources) tables of nested new concepts; the main quote is their first source."""
    examples = concepts.select("concept_key", F.explode("positive_examples").alias("text"), F.lit("POSITIVE").alias("kind")).unionByName(
        concepts.select("concept_key", F.explode("negative_examples").alias("text"), F.lit("NEGATIVE").alias("kind"))
    )
    quotes = F.array_distinct(F.concat(F.array("source_quote"), F.coalesce("sources", F.expr("cast(array() as array<string>)"))))
    sources = concepts.select("concept_key", F.posexplode(quotes).alias("ordinal", "quote")).where("quote IS NOT NULL").withColumn("quote_hash", F.sha2(F.trim("quote"), 256))
    return concepts.drop("positive_examples", "negative_examples", "sources"), examples, sources


def updated(table: DataFrame, changes: DataFrame, key: str, fields: str | None = None) -> DataFrame:
    """table with each change's values; rows without a change stay.

    Without `fields` a null says nothing. With it (a column of changes, an array of the
    names of columns that a change sets) a named column takes its value, null included.
    """
    told = changes.select(key, *(F.col(c).alias(f"new__{c}") for c in changes.columns if c != key))
    joined = table.join(told, key, "left")

    def value(c: str) -> Column:
        if c == key or c not in changes.columns or c == fields:
            return F.col(c)
        new = F.col(f"new__{c}")
        return F.coalesce(new, c).alias(c) if fields is None else F.when(F.array_contains(f"new__{fields}", c), new).otherwise(F.col(c)).alias(c)

    return joined.select(*map(value, table.columns))


def replaced_examples(examples: DataFrame, new: DataFrame, key: str = "concept_key") -> DataFrame:
    """A concept's examples give way to its new ones as a whole; concepts without new ones keep theirs."""
    return examples.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(examples.columns))


def stamped(table: DataFrame, old: DataFrame, key: str, now: Column, status: str = "status") -> DataFrame:
    """table with the time of each row's own move: updated_at where anything changed, activated_at and archived_at where its status did.

    table and old have the same columns, key and the stamps among them.
    """
    same = [c for c in table.columns if c not in (key, "updated_at", "activated_at", "archived_at")]
    before = old.select(key, *(F.col(c).alias(f"old__{c}") for c in same))
    joined = table.join(before, key, "left")
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old__{c}"))
    moved = lambda to: (F.col(status) == to) & ~F.col(status).eqNullSafe(F.col(f"old__{status}"))
    told = joined.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))
    for column, to in (("activated_at", "ACTIVE"), ("archived_at", "ARCHIVED")):
        told = told.withColumn(column, F.when(moved(to), now).otherwise(F.col(column)))
    return told.select(table.columns)


def owned(table: DataFrame, org_id: str, key: str, wanted: Column) -> DataFrame:
    """(key value, row or null): the row of a key, only if it belongs to this organisation."""
    return table.where((F.col(key) == wanted) & (F.col("org_id") == org_id))


def owned_children(children: DataFrame, parents: DataFrame, org_id: str, key: str) -> DataFrame:
    """Children whose parent belongs to this organisation."""
    return children.join(parents.where(F.col("org_id") == org_id).select(key), key, "left_semi")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The latest row of every key of both."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("new__"), F.desc(stamp))
    both = table.withColumn("new__", F.lit(0)).unionByName(rows.withColumn("new__", F.lit(1)))
    return both.withColumn("n__", F.row_number().over(latest)).where("n__ = 1").drop("n__", "new__")


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Without the rows of deleted keys; a null key is no reference and stays."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def set_null(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """References to deleted keys become null."""
    marked = gone.select(F.col(key).alias("gone__")).distinct()
    joined = table.join(marked, F.col(key) == F.col("gone__"), "left")
    return joined.withColumn(key, F.when(F.col("gone__").isNull(), F.col(key))).drop("gone__")


def cascade(parent: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {"parent": deleted(parent, gone, key)} | {name: deleted(child, gone, key) for name, child in children.items()}


def write_keyed(table: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A table by key hash: one folder a bucket, so that a change of some keys rewrites only theirs."""
    table.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


BUCKET = "bucket__"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_keyed(path: str, keys: list[str], buckets: int, changes: DataFrame, gone: DataFrame | None = None) -> list[int]:
    """Replace the rows of changes' keys (one row a key, the table's columns) and delete those of `gone`; the buckets rewritten.

    Only the touched buckets are read and written (dynamic partition overwrite), so the cost is that of
    the touched share. The new buckets are complete before they are moved into place, one after the
    other; a job that dies meanwhile is run again with the same changes, which gives the same table. Keys may be null.
    """
    spark = changes.sparkSession
    touched = changes.select(*keys).unionByName(gone.select(*keys)) if gone is not None else changes.select(*keys)
    touched = touched.distinct().withColumn(BUCKET, bucket_of(keys, buckets))
    numbers = sorted(r[BUCKET] for r in touched.select(BUCKET).distinct().collect())  # at most `buckets`
    if not numbers:
        return []
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(numbers))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    kept = old.alias("o").join(touched.drop(BUCKET).alias("t"), same, "left_anti")
    new = kept.unionByName(changes.withColumn(BUCKET, bucket_of(keys, buckets)).select(kept.columns))
    # a bucket that loses all its rows keeps an empty file, or dynamic overwrite would leave its old ones
    hollow = [b for b in numbers if b not in {r[BUCKET] for r in new.select(BUCKET).distinct().collect()}]
    new.repartition(len(numbers), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in hollow:
        old.limit(0).drop(BUCKET).write.mode("overwrite").parquet(f"{path}/{BUCKET}={b}")
    return numbers


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their numbers of rows."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fresh_only(rows: DataFrame, table: DataFrame, hashed: str = "text_hash") -> DataFrame:
    """Rows whose hash the table doesn't have yet; the first of equal new ones."""
    return rows.dropDuplicates([hashed]).join(table.select(hashed), hashed, "left_anti")


def highest_code(rules: DataFrame, code: str = "code") -> DataFrame:
    """One row, max_code: the largest number of codes like R-12, 0 without any."""
    number = F.nullif(F.regexp_extract(code, r"\AR-([0-9]+)\z", 1), F.lit("")).try_cast("int")
    return rules.agg(F.coalesce(F.max(number), F.lit(0)).alias("max_code"))


def with_codes(new: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """New rules with the codes that follow, three digits at least.

    Numbers come from counts by range partition, so no window has all rows in one task.
    """
    from promptlake.operators.numbering import numbered

    told = numbered(new, order).crossJoin(F.broadcast(highest_code(rules)))
    n = (F.col("max_code") + F.col("row_no")).cast("string")
    return told.withColumn("code", F.concat(F.lit("R-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))).drop("max_code", "row_no")


def activated(documents: DataFrame, document_id: str, org_id: str) -> DataFrame:
    """One document of an organisation active, its active one before archived; nothing changes if it has no such document."""
    mine = F.col("org_id").eqNullSafe(F.lit(org_id))
    this = mine & (F.col("document_id") == document_id)
    there = documents.where(this).limit(1).select(F.lit(True).alias("there__"))
    told = documents.join(F.broadcast(there), how="left")  # one row at most
    status = F.when(this, "ACTIVE").when(mine & (F.col("status") == "ACTIVE"), "ARCHIVED").otherwise(F.col("status"))
    return told.withColumn("status", F.when(F.col("there__"), status).otherwise(F.col("status"))).drop("there__")


def scoped_rules(rules: DataFrame, document_id: str) -> DataFrame:
    """On activation: extracted rules of other documents (or of none) rest, the document's own reviewed ones run."""
    own = F.col("document_id").eqNullSafe(F.lit(document_id))
    rest = (F.col("origin") == "AUTO") & ~own
    return rules.withColumn("is_active", F.when(rest, False).when(own & (F.col("status") == "ACTIVE"), True).otherwise(F.col("is_active")))


def in_step(rules: DataFrame) -> DataFrame:
    """A rule runs exactly while its status is ACTIVE."""
    return rules.withColumn("is_active", F.coalesce(F.col("status") == "ACTIVE", F.lit(False)))


def extraction_reset(chunks: DataFrame, rules: DataFrame, units: DataFrame, concepts: DataFrame, document_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a document's extraction (reviewed concepts stay), and one row of numbers removed."""
    own = F.col("document_id").eqNullSafe(F.lit(document_id))
    gone = {
        "chunks": (chunks, own),
        "rules": (rules, own & (F.col("origin") == "AUTO")),
        "units": (units, own),
        "concepts": (concepts, own & F.col("review_status").isin("DRAFT", "REVIEW")),
    }
    counts = None
    for name, (t, what) in gone.items():
        n = t.agg(F.count_if(what).alias(name))
        counts = n if counts is None else counts.crossJoin(n)
    return {name: t.where(~what) for name, (t, what) in gone.items()}, counts


def may_activate(documents: DataFrame, concepts: DataFrame, index: DataFrame) -> DataFrame:
    """(document_id, may_activate, n_active, n_waiting, n_indexed)."""
    state = concepts.groupBy("document_id").agg(
        F.count_if(F.col("review_status") == "ACTIVE").alias("n_active"), F.count_if(F.col("review_status").isin("DRAFT", "REVIEW", "PENDING_LLM")).alias("n_waiting")
    )
    known = concepts.where("review_status = 'ACTIVE'").join(index.select("concept_key"), "concept_key", "left_semi").groupBy("document_id").agg(F.count("*").alias("n_indexed"))
    told = documents.join(state, "document_id", "left").join(known, "document_id", "left")
    told = told.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_active", "n_waiting", "n_indexed")})
    ready = (F.col("processing") == "READY") & (F.col("status") == "REVIEW")
    return told.select("document_id", (ready & (F.col("n_active") > 0) & (F.col("n_waiting") == 0) & (F.col("n_indexed") == F.col("n_active"))).alias("may_activate"), "n_active", "n_waiting", "n_indexed")


#: Orders of a review list, first keys first; ties go to the caller's column.
ORDERS = {
    "risk": lambda: [F.desc(F.size("flags")), F.asc(F.coalesce("confidence", F.lit(0.8))), F.desc(F.length("source_quote"))],
    "confidence": lambda: [F.asc(F.coalesce("confidence", F.lit(0.8)))],
    "newest": lambda: [F.desc("created_at")],
}


def review_order(concepts: DataFrame, by: str = "risk", tie: str = "id") -> DataFrame:
    return concepts.orderBy(*ORDERS[by](), tie)


def riskiest_first(concepts: DataFrame, tie: str = "id") -> DataFrame:
    return review_order(concepts, "risk", tie)


def log_page(log: DataFrame, page: int, size: int, start=None, end=None, newest: str = "created_at", tie: str = "id", **equal) -> DataFrame:
    """One page of the log, newest first; both ends of the range belong to it."""
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    if start is not None:
        log = log.where(F.col(newest) >= F.lit(start).cast("timestamp"))
    if end is not None:
        log = log.where(F.col(newest) <= F.lit(end).cast("timestamp"))
    return log.orderBy(F.desc(newest), F.desc(tie)).offset((page - 1) * size).limit(size)


def audit_page(audit: DataFrame, limit: int, newest: str = "created_at", tie: str = "id") -> DataFrame:
    return audit.orderBy(F.desc(newest), F.desc(tie)).limit(min(limit, 500))


def safe_metadata(metadata: Column, longest: int = 300) -> Column:
    """map<string,string>: long values replaced by their length."""
    return F.transform_values(metadata, lambda _, v: F.when(F.length(v) > longest, F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(v).alias("length")))).otherwise(v))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def concept_from_rule(rules: DataFrame, concepts: DataFrame) -> DataFrame:
    """Keyword rules as concepts, for keys that don't exist yet."""
    key = F.regexp_replace(F.lower("code"), "[^0-9a-z]+", "_")
    action = F.create_map(*(F.lit(x) for x in ("BLOCK_EXTERNAL", "ROUTE_LOCAL", "MASK", "MASK_AND_ALLOW_EXTERNAL", "FLAG_REVIEW", "ROUTE_LOCAL")))
    level = F.create_map(*(F.lit(x) for x in ("CRITICAL", "HIGHLY_CONFIDENTIAL", "HIGH", "CONFIDENTIAL", "MEDIUM", "INTERNAL", "LOW", "INTERNAL")))
    told = rules.where(F.col("detector_type") == "SEMANTIC").select(
        key.alias("concept_key"),
        F.col("title").alias("name"),
        "keywords",
        F.coalesce(action[F.col("action")], F.lit("ROUTE_LOCAL")).alias("action"),
        F.coalesce(level[F.col("severity")], F.lit("CONFIDENTIAL")).alias("sensitivity"),
        F.lit("REVIEW").alias("review_status"),
    )
    return told.dropDuplicates(["concept_key"]).join(concepts.select("concept_key"), "concept_key", "left_anti")


def embedding_text(key: Column, name: Column, name_fa: Column, description: Column, positive: Column, conditions: Column, words: Column) -> Column:
    """What a concept's vector is made of (negative examples are not)."""
    from promptlake.functions.text import normalize

    bullets = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    title = F.when(F.coalesce(F.length(name_fa), F.lit(0)) > 0, name_fa).otherwise(name)
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("مفهوم: "), title, F.lit(" ("), key, F.lit(")")),
            F.concat(F.lit("شرح: "), description),
            bullets("نمونه‌های شمول", positive),
            bullets("شروط و استثناها", conditions),
            F.when(F.size(words) > 0, F.concat(F.lit("کلیدواژه‌ها: "), F.array_join(words, "، "))),
        )
    )
    return normalize(F.array_join(parts, "\n\n"))


def snapshot(documents: DataFrame, rules: DataFrame, chunks: DataFrame, org_id: str) -> tuple[DataFrame, DataFrame]:
    """(rules, restricted chunks) of an organisation's active document."""
    active = documents.where((F.col("org_id") == org_id) & (F.col("status") == "ACTIVE")).select("document_id")
    own = rules.where((F.col("org_id") == org_id) & F.col("is_active"))
    return own, chunks.where("is_restricted").join(active, "document_id", "left_semi").orderBy("document_id", "ordinal")
