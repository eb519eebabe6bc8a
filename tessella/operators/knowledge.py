"""Lifecycle of a corpus: upserts, deletes, versions, sync and crawl plans, registry, dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of ``old`` by key and adds the rest."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def sync_plan(files: DataFrame, versions: DataFrame, *, force: bool = False, prune: bool = False) -> DataFrame:
    """(doc_id, action) from (doc_id, hash) and each document's latest (doc_id, latest_hash)."""
    both = files.join(versions, "doc_id", "full")
    same = (F.col("hash") == F.col("latest_hash")) & F.lit(not force)
    action = F.when(F.col("hash").isNull(), "delete" if prune else "keep").when(F.col("latest_hash").isNull(), "ingest").when(same, "skip_unchanged").otherwise("reingest")
    return both.select("doc_id", action.alias("action"))


def crawl_plan(online: DataFrame, local: DataFrame, *, full: bool = False) -> DataFrame:
    """(article_id, action) from (article_id, online_at) and (article_id, local_at)."""
    both = online.join(local, "article_id", "full")
    action = F.when(F.col("online_at").isNull(), "deleted").when(F.lit(full) | F.col("local_at").isNull(), "new").when(F.col("online_at") > F.col("local_at"), "update").otherwise("skip")
    return both.select("article_id", action.alias("action"))


def last_versions(history: DataFrame, n: int, key: str = "doc_id", order: str = "created_at", tie: str = "version") -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def compress_history(turns: DataFrame, rounds: int) -> DataFrame:
    """Turns from the last ``rounds`` user turns on, and a summary row for conversations cut.

    (conv_id, turn, role, text); the summary row has turn -1. The rounds of a conversation
    are counted within it, and a conversation is short.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("_round", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = numbered.withColumn("_rounds", F.max("_round").over(Window.partitionBy("conv_id")))
    kept = total.where((F.col("_rounds") <= rounds) | (F.col("_round") > F.col("_rounds") - rounds)).select("conv_id", "turn", "role", "text")
    cut = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), F.count("*").alias("n")).where(F.col("u") > rounds)
    text = F.format_string("%d rounds: %d user, %d assistant, %d messages", "u", "u", "a", "n")
    return kept.unionByName(cut.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("summary").alias("role"), text.alias("text")))


def greedy_budget(items: Column, budget: int) -> Column:
    """Indexes kept from an array of (idx, words, score): best score first, the first always, others where they still fit."""
    ordered = F.array_sort(F.transform(items, lambda s: F.struct((-s["score"]).alias("o"), s["idx"].alias("idx"), s["words"].cast("long").alias("w"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = (F.size(state["kept"]) == 0) | (state["total"] + x["w"] <= budget)
        return F.struct(F.when(fits, state["total"] + x["w"]).otherwise(state["total"]).alias("total"), F.when(fits, F.array_append(state["kept"], x["idx"].cast("int"))).otherwise(state["kept"]).alias("kept"))

    return F.array_sort(F.aggregate(ordered, start, step, lambda s: s["kept"]))


def islands(df: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """``df`` with ``island``: the number of the run of equal values that a row stands in."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.withColumn("_v", value)
    start = F.coalesce((~F.lag("_v").over(w).eqNullSafe(F.col("_v"))).cast("int"), F.lit(1))
    return marked.withColumn("_s", start).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_v", "_s")


def breaker_states(events: DataFrame, limit: int = 3, recover_s: int = 300) -> DataFrame:
    """Per tool the failures in a row up to its last event, and whether the breaker is open at ``now``.

    (tool, ts, seq, ok); the streak since the last success opens the breaker at ``limit``.
    """
    last_ok = events.groupBy("tool").agg(F.max(F.when(F.col("ok"), F.struct("ts", "seq"))).alias("good"), F.max("ts").alias("last"))
    bad = events.where(~F.col("ok")).join(last_ok, "tool").where(F.col("good").isNull() | (F.struct("ts", "seq") > F.col("good")))
    streak = bad.groupBy("tool").agg(F.count("*").alias("failures"), F.max("ts").alias("failed_at"))
    now = events.agg(F.max("ts").alias("now"))
    joined = last_ok.join(streak, "tool", "left").crossJoin(F.broadcast(now))
    failures = F.coalesce("failures", F.lit(0))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("failed_at").cast("timestamp"))
    is_open = (failures >= limit) & (age < recover_s)
    return joined.select("tool", failures.alias("failures"), F.when(is_open, "open").otherwise("closed").alias("state"), F.when(is_open, recover_s - age).otherwise(0).cast("long").alias("recover_in"))
