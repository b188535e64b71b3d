"""Conversations: admission, the last messages, their canonical form and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlake.functions.text import sha256, strip

ROLES = ("system", "user", "assistant")
WINDOW = 30
MAX_PAYLOAD = 24_000


def admitted(messages: DataFrame) -> DataFrame:
    """Messages of a known role with something in them, trimmed."""
    return messages.withColumn("text", strip(F.col("text"))).where(F.col("role").isin(*ROLES) & (F.length("text") > 0))


def last_messages(messages: DataFrame, n: int = WINDOW) -> DataFrame:
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return messages.withColumn("back__", F.row_number().over(latest)).where(F.col("back__") <= n).drop("back__")


def last_user_message(messages: DataFrame) -> DataFrame:
    """The text of each conversation's last user message (null if it has none)."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return messages.groupBy("conv_id").agg(F.max(user).getField("text").alias("text"))


def folded(messages: DataFrame) -> DataFrame:
    """(conv_id, payload, dlp_text, n_messages): the canonical JSON, and all texts joined by line breaks."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    one = messages.groupBy("conv_id").agg(turns.alias("turns"))
    said = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return one.select(
        "conv_id",
        F.to_json(said).alias("payload"),
        F.array_join(F.transform("turns", lambda m: m["text"]), "\n").alias("dlp_text"),
        F.size("turns").alias("n_messages"),
    )


def payload_hash(payload: Column) -> Column:
    return sha256(payload)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def policy_revision(concepts: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, revision, ready) of active documents: ready with an active concept and none waiting."""
    state = concepts.groupBy("document_id").agg(
        F.count_if(F.col("review_status") == "ACTIVE").alias("active"),
        F.count_if(F.col("review_status").isin("DRAFT", "REVIEW")).alias("waiting"),
        F.array_sort(F.collect_list(F.struct("concept_key", "sensitivity", "action", "updated_at"))).alias("told"),
    )
    active = documents.where(F.col("status") == "ACTIVE").select("document_id", "updated_at")
    joined = active.join(state, "document_id", "left")
    ready = F.coalesce((F.col("active") > 0) & (F.col("waiting") == 0), F.lit(False))
    return joined.select("document_id", sha256(F.to_json(F.struct("document_id", "updated_at", "told"))).alias("revision"), ready.alias("ready"))


def still_current(decisions: DataFrame, revisions: DataFrame) -> DataFrame:
    """decisions with `current`: whether their policy revision is the one in force. Nothing is lost."""
    now = revisions.where("ready").select("document_id", F.col("revision").alias("now__"))
    return decisions.join(now, "document_id", "left").withColumn("current", F.coalesce(F.col("revision") == F.col("now__"), F.lit(False))).drop("now__")


#: A tenant's history and its requests meet by days of this length.
DAY_S = 86_400


def policies_in_force(requests: DataFrame, history: DataFrame, key: str, tenant: str = "org_id", at: str = "at", document: str = "document_id", status: str = "status", order: str = "version") -> DataFrame:
    """(key, n_active, document, in_force): at each request's time, how many documents of its tenant are ACTIVE, and which if it is just one.

    history (tenant, document, status, at, order) lists changes of state; one at the request's very time counts, and of
    changes at one time the last by `order`. Requests without a time or tenant, or before any change, have none in force. The history becomes
    intervals with a running count of active documents; intervals and requests meet by tenant and day, so a
    tenant with a third of all requests is as many keys as it has days.
    """
    ticks = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day = lambda c: F.floor(c / (DAY_S * 1_000_000))
    each = Window.partitionBy(tenant, document).orderBy("t__", order)
    told = history.where(F.col(tenant).isNotNull() & F.col(at).isNotNull()).select(tenant, document, order, ticks(at).alias("t__"), (F.coalesce(F.col(status), F.lit("")) == "ACTIVE").cast("int").alias("on__"))
    told = told.withColumn("step__", F.col("on__") - F.coalesce(F.lag("on__").over(each), F.lit(0))).where("step__ <> 0")
    # a sum of numbers that stand for documents is the one document's number where only one is active
    number = F.xxhash64(document).cast("decimal(38,0)")
    moves = told.groupBy(tenant, "t__").agg(F.sum("step__").alias("n"), F.sum(F.col("step__") * number).alias("which"))
    line = Window.partitionBy(tenant).orderBy("t__")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    spans_ = moves.select(tenant, "t__", F.lead("t__").over(line).alias("until__"), F.sum("n").over(upto).alias("n_active"), F.sum("which").over(upto).alias("which__"))
    asked = requests.select(key, F.col(tenant).alias("tenant__"), ticks(at).alias("at__"))
    last = asked.agg(F.max("at__").alias("last__"))
    # one row with the last request's time
    spans_ = spans_.crossJoin(F.broadcast(last)).where("t__ <= last__").withColumn("until__", F.coalesce("until__", F.col("last__") + 1))
    spans_ = spans_.where("until__ > t__").withColumn("day__", F.explode(F.sequence(day(F.col("t__")), day(F.least(F.col("until__") - 1, F.col("last__"))))))
    met = asked.withColumn("day__", day(F.col("at__"))).alias("a").join(
        spans_.alias("s"), (F.col("a.tenant__") == F.col(f"s.{tenant}")) & (F.col("a.day__") == F.col("s.day__")) & (F.col("a.at__") >= F.col("s.t__")) & (F.col("a.at__") < F.col("s.until__")), "left"
    )
    found = met.select(F.col(f"a.{key}").alias(key), F.col("a.tenant__").alias("tenant__"), F.coalesce("s.n_active", F.lit(0)).cast("bigint").alias("n_active"), F.when(F.col("s.n_active") == 1, F.col("s.which__")).alias("which__"))
    names = told.select(F.col(tenant).alias("of__"), number.alias("which__"), F.col(document).alias("document")).distinct()
    named = found.alias("f").join(names.alias("n"), (F.col("f.tenant__") == F.col("n.of__")) & (F.col("f.which__") == F.col("n.which__")), "left")
    return named.select(F.col(f"f.{key}").alias(key), F.col("f.n_active").alias("n_active"), F.col("n.document").alias("document"), (F.col("f.n_active") == 1).alias("in_force"))
