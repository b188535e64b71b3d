"""Evaluation: counts over predicted and expected, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def decision_stats(log: DataFrame, today: Column, action: str = "action", created: str = "created_at") -> DataFrame:
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(action) == "BLOCK").alias("blocked"),
        F.count_if(F.col(action) == "ALLOW").alias("allowed"),
        F.count_if(F.date_trunc("day", F.col(created)) == F.date_trunc("day", today)).alias("today"),
    )


def status_counts(concepts: DataFrame, statuses: list[str], by: list[str] | None = None, status: str = "review_status") -> DataFrame:
    return concepts.groupBy(*(by or [])).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, query: str = "query_id", key: str = "id", rank: str = "rank", at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at k (any expected row among the first k) and mean reciprocal rank, over queries that expect something."""
    hits = ranked.join(expected.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.min(rank).alias("first"))
    every = expected.select(query).distinct().join(hits, query, "left")
    return every.agg(
        F.count("*").alias("n_queries"),
        *(ratio(F.count_if(F.col("first") <= k), F.count("*")).alias(f"recall_at_{k}") for k in at),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )


def classifier_metrics(rows: DataFrame, expected: str = "expected", actual: str = "actual", by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 of SENSITIVE, accuracy on SAFE, and answers that decided nothing."""
    e, a = F.col(expected), F.col(actual)
    n = lambda c: F.count_if(c)
    tp, fp = n((e == "SENSITIVE") & (a == "SENSITIVE")), n((e == "SAFE") & (a == "SENSITIVE"))
    tn, n_sensitive, n_safe = n((e == "SAFE") & (a == "SAFE")), n(e == "SENSITIVE"), n(e == "SAFE")
    precision, recall = ratio(tp, tp + fp), ratio(tp, n_sensitive)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        ratio(n(e == a), F.count("*")).alias("accuracy"),
        precision.alias("sensitive_precision"),
        recall.alias("sensitive_recall"),
        ratio(2 * precision * recall, precision + recall).alias("sensitive_f1"),
        ratio(tn, n_safe).alias("safe_accuracy"),
        n(a == "UNCERTAIN").alias("n_undecided"),
    )


def end_to_end_metrics(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Routes against expected ones (EXTERNAL, LOCAL, BLOCKED). Lenient: whatever stays inside is right for both LOCAL and BLOCKED."""
    e = F.col("expected")
    actual = F.when(F.col("route").isin("EXTERNAL_DIRECT", "EXTERNAL"), "EXTERNAL").otherwise(F.col("route"))
    right = (actual == e) if strict else ((actual == "EXTERNAL") == (e == "EXTERNAL"))
    inside = e != "EXTERNAL"
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        ratio(F.count_if(right), F.count("*")).alias("accuracy"),
        ratio(F.count_if(inside & (actual != "EXTERNAL")), F.count_if(inside)).alias("sensitive_recall"),
        ratio(F.count_if(~inside & (actual == "EXTERNAL")), F.count_if(~inside)).alias("safe_accuracy"),
        F.count_if((e == "BLOCKED") & (actual == "EXTERNAL")).alias("critical_misses"),
    )


def nearest_rank(values: DataFrame, value: str, share: float, by: list[str] | None = None) -> DataFrame:
    """(*by, value, n): the element at floor(n * share) of each group's sorted values.

    Equal values are counted first. Without groups, approximate quantiles bracket the
    place, so only a narrow band of values meets in one task.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("n"))
    if by:
        seen = counts.withColumn("seen", F.sum("n").over(Window.partitionBy(*by).orderBy(value)))
        joined = seen.join(counts.groupBy(*by).agg(F.sum("n").alias("total")), by)
        return joined.where(F.col("seen") > F.floor(F.col("total") * share)).groupBy(*by).agg(F.min(value).alias("value"), F.first("total").alias("n"))
    error = 1e-3
    around = [max(0.0, share - error), min(1.0, share + error)]
    told = values.agg(F.count(value).alias("n"), F.percentile_approx(value, around, 10_000).alias("band"))
    band = counts.crossJoin(F.broadcast(told.withColumnRenamed("n", "total"))).withColumn("below", F.col(value) < F.col("band")[0])
    low = band.where("below").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    inside = band.where(~F.col("below") & (F.col(value) <= F.col("band")[1]))
    seen = inside.withColumn("seen", F.sum("n").over(Window.partitionBy("total").orderBy(value))).crossJoin(F.broadcast(low))
    return seen.where(F.col("seen") + F.col("before") > F.floor(F.col("total") * share)).agg(F.min(value).alias("value"), F.first("total").alias("n"))


def calibration_grid(rows: DataFrame, confidences: list[float], noises: list[float], least_recall: float = 0.9, least_accuracy: float = 0.85) -> DataFrame:
    """Every pair of thresholds over rows (score, expected SENSITIVE or SAFE), and whether it is accepted.

    The grid is a few rows, so each text is judged for all pairs where it is.
    """
    grid = F.array(*(F.struct(F.lit(c).alias("sensitive_from"), F.lit(n).alias("noise_below")) for c in confidences for n in noises))
    told = rows.select("expected", "score", F.explode(grid).alias("g")).select("expected", "score", "g.*")
    actual = F.when(F.col("score") < F.col("noise_below"), "SAFE").when(F.col("score") >= F.col("sensitive_from"), "SENSITIVE").otherwise("UNCERTAIN")
    metrics = classifier_metrics(told.withColumn("actual", actual), by=["sensitive_from", "noise_below"])
    return metrics.withColumn("accepted", (F.col("sensitive_recall") >= least_recall) & (F.col("accuracy") >= least_accuracy))


def pass_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("route") == F.col("expected")).alias("passed"), F.count("*").alias("total"))
