"""Quality report of a batch, exact duplicate clusters, and duplicates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

# Limits of the report.
MAX_EMPTY, MAX_DUPLICATE, MIN_LENGTH = 0.2, 0.3, 5


def dedup_latest(df: DataFrame, *, text: Column, newest: Column, position: Column) -> DataFrame:
    """The newest row of each group of equal cleaned, lower-cased texts; ties keep the lowest position.

    A text that cleans to nothing is never a duplicate. The winner of each key is found by
    an aggregation that combines before the shuffle, so a key that holds a third of all rows
    is no burden; rows then meet their key's winner in a join that can be split. The join
    takes nulls as equal, since a test for null would be pushed down and hash every text again.
    """
    # the hash stands in a column of its own before it is tested, so that it is computed once
    hashed = df.withColumn("_at", position).withColumn("_h", F.sha2(F.lower(T.clean_text(text)), 256))
    empty = F.sha2(F.lit(""), 256)  # texts that clean to nothing get a key of their own
    marked = hashed.withColumn("_h", F.when(F.col("_h") == empty, F.concat(F.lit("-"), F.col("_at").cast("string"))).otherwise(F.col("_h")))
    rank = F.struct(F.unix_micros(newest).alias("t"), (-F.col("_at")).alias("p"))
    winners = marked.groupBy(F.col("_h").alias("_k")).agg(F.max(rank).alias("_w")).select("_k", (-F.col("_w.p")).alias("_p"))
    return marked.join(winners, F.col("_h").eqNullSafe(F.col("_k")) & F.col("_at").eqNullSafe(F.col("_p")), "left_semi").drop("_h", "_at")


def dedup_first(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """The first row of each key."""
    marked = df.withColumn("_key", key).withColumn("_at", position)
    first = marked.groupBy("_key").agg(F.min("_at").alias("_at"))
    return marked.join(first, ["_key", "_at"], "left_semi").drop("_key", "_at")


def best_copies(df: DataFrame, key: str, score: Column, position: Column) -> DataFrame:
    """The row of each key with the highest score; of equal scores the first, and scores before none."""
    marked = df.withColumn("_s", score).withColumn("_at", position)
    order = F.struct(F.col("_s").isNull().alias("none"), (-F.col("_s")).alias("s"), F.col("_at").alias("at"))
    best = marked.groupBy(key).agg(F.min(order).alias("_b")).select(key, F.col("_b.at").alias("_at"))
    return marked.join(best, [key, "_at"], "left_semi").drop("_s", "_at")


def distinct_after_fusion(df: DataFrame, key: Column, text: Column, position: Column, threshold: float = 1.0) -> DataFrame:
    """The first row of each key; below a ``threshold`` of 1 also one row of each group of equal cleaned texts."""
    first = dedup_first(df, key, position)
    if threshold >= 1:
        return first
    return dedup_latest(first, text=text, newest=F.timestamp_seconds(F.lit(0)), position=position)


def block_key(idx: Column, text: Column, summary: Column, title: Column) -> Column:
    """Identity of a block: its index, or a hash of its text where the index is negative."""
    body = F.coalesce(*(F.nullif(T.filled(c), F.lit("")) for c in (text, summary, title)), F.lit(""))
    return F.when(idx >= 0, F.concat(F.lit("i"), idx.cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(body, 256)))


def report(df: DataFrame, text: Column) -> DataFrame:
    """One row: sizes, ratios, leftover markup and verdict; an empty batch does not pass."""
    t = T.stripped(T.filled(text))
    rows = df.select(t.alias("t"), F.when(t != "", F.sha2(t, 256)).alias("h"))
    full = F.col("t") != ""
    n = F.count("*")
    stats = rows.agg(
        n.alias("total"),
        F.count_if(~full).alias("empty"),
        F.count_if(full).alias("filled"),
        F.count_distinct("h").alias("texts"),
        F.coalesce(F.avg(F.when(full, F.length("t"))), F.lit(0.0)).alias("mean"),
        F.count_if(full & F.rlike("t", F.lit(T.HTML_TAG))).alias("html_leftover_count"),
    )
    empty = F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("empty") / F.col("total"), 4))
    same = F.when(F.col("filled") == 0, 0.0).otherwise(F.round((F.col("filled") - F.col("texts")) / F.col("filled"), 4))
    out = stats.select("total", empty.alias("empty_ratio"), same.alias("duplicate_ratio"), F.round("mean", 1).alias("avg_length"), "html_leftover_count", "filled", "mean")
    bad = (F.col("empty_ratio") > MAX_EMPTY) | (F.col("duplicate_ratio") > MAX_DUPLICATE) | ((F.col("filled") > 0) & (F.col("mean") < MIN_LENGTH)) | (F.col("html_leftover_count") > 0) | (F.col("total") == 0)
    return out.select("total", "empty_ratio", "duplicate_ratio", "avg_length", "html_leftover_count", (~bad).alias("passed"))


def ranked_within(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
