"""Streams: daily log statistics, the login limiter, chat events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 300
ATTEMPTS = 5


def daily_stats(log: DataFrame, created: str = "created_at", action: str = "action", late: str = "1 hour") -> DataFrame:
    """Counts by day; works on streams (with a watermark) and tables alike."""
    told = log.withWatermark(created, late) if log.isStreaming else log
    return told.groupBy(F.window(created, "1 day").getField("start").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col(action) == "BLOCK").alias("blocked"), F.count_if(F.col(action) == "ALLOW").alias("allowed")
    )


def _judge(opened: float | None, count: int, at: float, window: float, attempts: int) -> tuple[float, int, bool]:
    """The window opens at a key's first attempt and anew once it has run out."""
    if opened is None or at > opened + window:
        return at, 1, attempts < 1
    return opened, count + 1, count + 1 > attempts


def limited(attempts: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", window: int = WINDOW_S, most: int = ATTEMPTS) -> DataFrame:
    """attempts with `attempt_no` in its window and `blocked`. The batch twin of the stream, by native folds.

    A window is anchored at its first attempt, so rows are folded in time order; a key's
    times are first cut where attempts lie further apart than the window, which never
    lie in one window, so a busy key is many small folds as far as its pauses allow.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    second = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    told = attempts.withColumn("s__", second)
    told = told.withColumn("run__", F.sum(F.when(F.col("s__") - F.lag("s__").over(order) <= window, 0).otherwise(1)).over(order))
    rows = F.array_sort(F.collect_list(F.struct("s__", tie)))
    start = F.struct(F.lit(None).cast("double").alias("opened"), F.lit(0).alias("n"), F.expr(f"cast(array() as array<struct<{tie}: bigint, n: int>>)").alias("out"))

    def step(s, x):
        fresh = s["opened"].isNull() | (x["s__"] > s["opened"] + window)
        n = F.when(fresh, 1).otherwise(s["n"] + 1)
        return F.struct(F.when(fresh, x["s__"]).otherwise(s["opened"]).alias("opened"), n.alias("n"), F.concat(s["out"], F.array(F.struct(x[tie].alias(tie), n.alias("n")))).alias("out"))

    folded = told.groupBy(key, "run__").agg(F.aggregate(rows, start, step, lambda s: s["out"]).alias("o"))
    each = folded.select(key, F.explode("o").alias("o")).select(key, F.col(f"o.{tie}").alias(tie), F.col("o.n").alias("attempt_no"))
    return each.withColumn("blocked", F.col("attempt_no") > most)


def limited_stream(attempts: DataFrame, key: str = "user_id", at: str = "ts", window: int = WINDOW_S, most: int = ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """The limiter on a stream: (key, ts, attempt_no, blocked), one state per key.

    Time is the attempts' own: a key's attempts of one micro-batch are judged in their
    order, those later than `late` behind the newest are dropped by the watermark, and a
    state goes when the watermark has passed its window's end.
    """

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        told = []
        for ts in sorted(ts for rows in batches for ts in rows["ts"]):
            opened, count, blocked = _judge(opened, count, ts.timestamp(), window, most)
            told.append((keys[0], ts, count, blocked))
        yield pd.DataFrame(told, columns=["key", "ts", "attempt_no", "blocked"])
        ends = int((opened + window) * 1000) + 1
        if ends > state.getCurrentWatermarkMs():
            state.update((opened, count))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()

    kind = attempts.schema[key].dataType.simpleString()
    return (
        attempts.withWatermark(at, late)
        .select(F.col(key).alias("key"), F.col(at).alias("ts"))
        .groupBy("key")
        .applyInPandasWithState(
            fold, f"key {kind}, ts timestamp, attempt_no int, blocked boolean", "opened double, count int", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def sse_events(body: Column) -> Column:
    """The JSON of every complete event of a text/event-stream body; an unended last one is left out."""
    blocks = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n", -1)
    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    data = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, r"\Adata: ?", ""))
    return F.filter(F.transform(whole, lambda b: F.array_join(data(b), "\n")), lambda d: d != "")


def sse_remainder(body: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n", -1), -1)


def answer(events: Column) -> Column:
    """The final answer: the deltas in order."""
    told = F.transform(events, lambda e: F.from_json(e, "struct<type: string, delta: string>"))
    return F.array_join(F.transform(F.filter(told, lambda e: (e["type"] == "delta") & e["delta"].isNotNull()), lambda e: e["delta"]), "")


def sse_rows(events: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, body): events (key, seq, payload) as one event-stream text."""
    told = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("e"))
    return told.select(key, F.array_join(F.transform("e", lambda e: F.concat(F.lit("data: "), e["payload"], F.lit("\n\n"))), "").alias("body"))
