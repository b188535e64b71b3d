"""Append-only logs, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.operators.store import safe_metadata
from promptlake.sources.batches import BatchStore

# What a decision's row holds when its writer says nothing.
DEFAULTS = {"action": "BLOCK", "risk": "low", "route": "LOCAL", "score": 0.0, "external_used": False, "n_masked": 0}
MAX_NOTE = 300


def decision_rows(decisions: DataFrame) -> DataFrame:
    """decisions with the defaults filled in, a time and its day."""
    out = decisions
    for column, value in DEFAULTS.items():
        out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in decisions.columns else F.lit(value))
    stamp = F.coalesce("created_at", F.current_timestamp()) if "created_at" in decisions.columns else F.current_timestamp()
    return out.withColumn("created_at", stamp).withColumn("day", F.to_date("created_at"))


def append(rows: DataFrame, path: str) -> None:
    """Rows into their days' folders; each day gets as many files as its size asks for, not one task."""
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def audit_rows(events: DataFrame) -> DataFrame:
    return events.withColumn("metadata", safe_metadata(F.col("metadata"), MAX_NOTE)).withColumn("day", F.to_date("created_at"))


def _once(store: BatchStore, stream: str, table: str, rows):
    """A sink that commits rows(batch, number) as the batch's part of a table, unless the store has the batch."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"{stream}-{number}"
        if name in store.batches():
            # a batch must be run to its end, or a stream's state would lag behind
            batch.write.format("noop").mode("overwrite").save()
            return
        attempt = store.begin()
        store.write(attempt, table, rows(batch, number))
        store.commit(attempt, name)

    return write


def stream_sink(store: BatchStore, stream: str, table: str = "decisions"):
    """For writeStream.foreachBatch: a micro-batch's rows once, however often it is run.

    A batch is known by the stream's name and its number, which Spark repeats when it
    runs a batch again after a failure. Its rows are seen when the batch is committed, and
    a batch that is committed already adds nothing.
    """
    return _once(store, stream, table, lambda batch, _: decision_rows(batch))


def latest_sink(store: BatchStore, stream: str, table: str = "daily"):
    """For writeStream.foreachBatch in update mode: each micro-batch's changed totals, with the batch's number."""
    return _once(store, stream, table, lambda batch, number: batch.withColumn("batch_no", F.lit(number).cast("bigint")))


def latest(store: BatchStore, schema: str, key: str, table: str = "daily") -> DataFrame:
    """The totals of the last batch that changed each key."""
    told = store.read(table, f"{schema}, batch_no bigint")
    others = [c for c in told.columns if c not in (key, "batch_no")]
    last = told.groupBy(key).agg(F.max_by(F.struct(*others), "batch_no").alias("last"))
    return last.select(key, "last.*")
