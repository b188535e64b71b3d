"""Streams that stop and start again, and merges that touch only their buckets."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptlake.operators import store
from promptlake.sources import logs
from promptlake.sources.batches import BatchStore, work_path
from promptlake.streaming import logs as stream_logs

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAILY = "day timestamp, total bigint, blocked bigint, allowed bigint"


class Killed(Exception):
    pass


def feed(spark, tmp_path, n=4):
    """Four files of decisions over three days."""
    rows = [(i, f"2024-01-{1 + i * 3 // 400:02d} {i % 24:02d}:00:00", "BLOCK" if i % 3 == 0 else "ALLOW") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, at string, action string").select("id", F.col("at").cast("timestamp").alias("created_at"), "action")
    for k in range(n):
        df.where(F.col("id").between(k * 100, k * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    return df


def started(spark, tmp_path, sink, totals):
    source = spark.readStream.schema("id bigint, created_at timestamp, action string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    told, mode, name = (stream_logs.daily_stats(source, late="30 days"), "update", "totals") if totals else (source, "append", "rows")
    return told.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).foreachBatch(sink).start()


def dying(sink, at, commits, kept):
    """A sink that dies at a batch, before or after it has committed."""

    def write(batch, number):
        if number == at and not commits:
            kept.write(kept.begin(), "decisions", batch)  # files without a marker
            raise Killed
        sink(batch, number)
        if number == at:
            raise Killed

    return write


@pytest.mark.parametrize("commits", [False, True])
def test_a_stream_that_dies_and_starts_again_doubles_nothing(spark, tmp_path, commits):
    df = feed(spark, tmp_path)
    rows, totals = BatchStore(spark, f"{tmp_path}/rows-store"), BatchStore(spark, f"{tmp_path}/totals-store")
    sinks = [(rows, logs.stream_sink(rows, "log"), False), (totals, logs.latest_sink(totals, "daily"), True)]
    for kept, sink, is_total in sinks:
        with pytest.raises(Exception, match="Killed"):
            started(spark, tmp_path, dying(sink, 1, commits, kept), is_total).awaitTermination()
        started(spark, tmp_path, sink, is_total).awaitTermination()
        assert len(kept.batches()) >= 4
    ids = [r.id for r in rows.read("decisions", "id bigint, created_at timestamp, action string, risk string").collect()]
    assert sorted(ids) == list(range(400))
    wanted = {(r.day, r.total, r.blocked, r.allowed) for r in stream_logs.daily_stats(df).collect()}
    assert {(r.day, r.total, r.blocked, r.allowed) for r in logs.latest(totals, DAILY, "day").collect()} == wanted


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_only_its_buckets(spark):
    path = work_path(spark, "test-merge")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [(i, f"n{i}") for i in range(2000)] + [(None, "none")]
    store.write_keyed(spark.createDataFrame(rows, "id bigint, name string"), path, ["id"], 50)
    local = path.removeprefix("file://").removeprefix("file:")
    before = files(local)
    changes = spark.createDataFrame([(5, "five"), (2500, "new"), (None, "still none")], "id bigint, name string")
    numbers = store.merge_keyed(path, ["id"], 50, changes, spark.createDataFrame([(7,), (9999,)], "id bigint"))
    after = files(local)
    assert 1 <= len(numbers) <= 5 and len(before - after) <= len(numbers) < 50, "untouched files stay"
    want = dict(rows) | {5: "five", 2500: "new", None: "still none"}
    del want[7]
    assert {r.id: r.name for r in spark.read.parquet(path).collect()} == want
    assert store.merge_keyed(path, ["id"], 50, changes.limit(0)) == []


def test_a_bucket_may_lose_all_its_rows(spark):
    path = work_path(spark, "test-hollow")
    store.write_keyed(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string"), path, ["id"], 100)
    store.merge_keyed(path, ["id"], 100, spark.createDataFrame([], "id bigint, name string"), spark.createDataFrame([(1,)], "id bigint"))
    assert [(r.id, r.name) for r in spark.read.parquet(path).select("id", "name").collect()] == [(2, "b")]
