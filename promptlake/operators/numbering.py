"""Consecutive row numbers without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, column: str = "row_no", buckets: int = 64) -> DataFrame:
    """df with row numbers from 1 by `order` (its values differ from one another).

    Approximate quantiles cut the values into ranges; rows are numbered within their
    range and moved on by the sizes of the ranges before, a table of at most `buckets` rows.
    """
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    at = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.expr("cast(array() as array<bigint>)"), lambda c: c < F.col(order)))
    told = df.withColumn("range__", at)
    sizes = told.groupBy("range__").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before__", F.coalesce(F.sum("n").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("range__").orderBy(order))
    return told.join(F.broadcast(before), "range__").withColumn(column, within + F.col("before__")).drop("range__", "before__")


def in_groups(df: DataFrame, by: str, order: list[str], column: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with row numbers from 1 within each `by` (null is one, too), by `order`.

    Rows are sorted into ranges of (by, order) and numbered within a range's share of the group; each
    share then moves on by the sizes of the group's earlier shares. So a group that holds a third
    of all rows is numbered by many tasks. Rows equal in `order` are numbered in any order.
    `keep` writes a table and reads it back, so that the ranges are the same for both steps.
    """
    dealt = keep(df.repartitionByRange(by, *order).withColumn("part__", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("part__", by).orderBy(*order))
    told = dealt.withColumn("within__", within)
    sizes = told.groupBy(by, "part__").agg(F.max("within__").alias("n__"))
    earlier = Window.partitionBy(by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(by).alias("by__"), F.col("part__").alias("of__"), F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("before__"))
    joined = told.join(before, F.col(by).eqNullSafe(F.col("by__")) & (F.col("part__") == F.col("of__")))
    return joined.select(*(F.col(c) for c in df.columns), (F.col("within__") + F.col("before__")).alias(column))


def placed(df: DataFrame, by: str, coarse: list[str], value: str, tie: str, column: str = "place", buckets: int = 64) -> DataFrame:
    """df with each row's place from 1 within its group `by`: by the few values of `coarse`, then `value` from high to low, then `tie`.

    A group is cut by quantiles of `value`, and the rows of a value so frequent that it
    is a quantile itself by those of `tie`, so a large group is numbered in many tasks.
    Both are numbers; `tie` tells a group's rows apart.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, shares, 1000).alias("v"), F.percentile_approx(tie, shares, 1000).alias("t")).first()
    cuts = [F.array(*(F.lit(c).cast(df.schema[name].dataType) for c in sorted(set(found)))) if found else F.array().cast(f"array<{df.schema[name].dataType.simpleString()}>") for name, found in ((value, row.v), (tie, row.t))]
    exact = F.coalesce(F.array_contains(cuts[0], F.col(value)), F.lit(False))
    above = F.size(F.filter(cuts[0], lambda c: c > F.col(value))) * 2 + F.when(exact, 1).otherwise(0)
    told = df.withColumn("range__", above).withColumn("part__", F.when(exact, F.size(F.filter(cuts[1], lambda c: c < F.col(tie)))).otherwise(0))
    keys = [by, *coarse, "range__", "part__"]
    ordered = Window.partitionBy(by).orderBy(*coarse, "range__", "part__").rowsBetween(Window.unboundedPreceding, -1)
    before = told.groupBy(*keys).agg(F.count("*").alias("n__")).withColumn("before__", F.coalesce(F.sum("n__").over(ordered), F.lit(0))).drop("n__")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))
    numbered_ = told.withColumn("within__", within).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = numbered_.join(before.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.within__") + F.col("b.before__")).alias(column))
