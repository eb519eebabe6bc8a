"""Snapshots of request samples, and alerts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics that alert, their limits and levels.
LIMITS = {
    "error_rate": (0.05, "critical"),
    "retrieval_p95_ms": (2000.0, "warning"),
    "answer_p95_ms": (5000.0, "warning"),
    "fallback_rate": (0.8, "warning"),
    "generation_error_rate": (0.1, "critical"),
}


def _counts(pairs: DataFrame, key: str) -> DataFrame:
    """One row: the counts of each value of ``key`` as text, by name. Values are a few names."""
    each = pairs.groupBy(key).agg(F.count("*").alias("n"))
    return each.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(key), F.col("n").cast("string")))), ",").alias(key))


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n / of, 4)).otherwise(0.0)


def full_snapshot(requests: DataFrame, retrievals: DataFrame, answers: DataFrame) -> DataFrame:
    """One row from requests (stage, null where all went well), retrievals (ms) and answers (ms, backend, ok).

    Shares of answers are of all answers; backends are counted where generation went well.
    Medians and other percentiles interpolate; without samples everything is 0.
    """
    p = lambda x: F.coalesce(F.round(F.percentile("ms", F.lit(x)), 2), F.lit(0.0))
    mean = F.coalesce(F.round(F.avg("ms"), 2), F.lit(0.0))
    a = requests.agg(F.count("*").alias("request_count"), F.count("stage").alias("error_count"))
    b = _counts(requests.where("stage is not null"), "stage").withColumnRenamed("stage", "errors_by_stage")
    c = retrievals.agg(F.count("*").alias("retrieval_count"), mean.alias("retrieval_avg_ms"), p(0.5).alias("retrieval_p50_ms"), p(0.95).alias("retrieval_p95_ms"), p(0.99).alias("retrieval_p99_ms"))
    d = answers.agg(F.count("*").alias("answer_count"), mean.alias("answer_avg_ms"), p(0.5).alias("answer_p50_ms"), p(0.95).alias("answer_p95_ms"), F.count_if(F.col("ok") & (F.col("backend") == "local")).alias("_local"), F.count_if(~F.col("ok")).alias("generation_error_count"))
    e = _counts(answers.where("ok"), "backend").withColumnRenamed("backend", "backend_usage")
    row = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)  # one row each
    n = F.col("answer_count")
    return row.withColumn("error_rate", _share(F.col("error_count"), F.col("request_count"))).withColumn("fallback_rate", _share(F.col("_local"), n)).withColumn("generation_error_rate", _share(F.col("generation_error_count"), n)).drop("_local")


def check_alerts(snapshot: DataFrame, limits: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """(metric, value, most, level) of the metrics of a snapshot that are above their limit."""
    limits = LIMITS | (limits or {})
    each = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(most).alias("most"), F.lit(level).alias("level")) for name, (most, level) in limits.items()))
    return snapshot.select(F.inline(each)).where("value > most")
