"""Event-time queries over a stream of events, each with a batch twin of the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, *, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean and errors of each window and event type."""
    bucket = F.window("ts", size, slide) if slide else F.window("ts", size)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(bucket.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def error_rates(events: DataFrame, *, late: str = "10 minutes", size: str = "5 minutes", most: float = 0.05) -> DataFrame:
    """(start, n, error_rate, alert) of each window: the share of errors, and whether it is above ``most``."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rate = F.round(F.col("errors") / F.col("n"), 4)
    return g.select(F.col("w.start").alias("start"), "n", rate.alias("error_rate"), (rate > most).alias("alert"))


def sessions(events: DataFrame, *, late: str = "10 minutes", gap: str = "1 minutes") -> DataFrame:
    """Sessions of each user: events with less than ``gap`` between them."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "errors")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first event of each key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    """Events of some types as JSON lines and as server-sent events."""
    chosen = events.where(F.col("event_type").isin(types))
    body = F.to_json(F.struct("event_id", "event_type", "value"))
    return chosen.select("event_id", body.alias("json"), F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), body, F.lit("\n\n")).alias("sse"))


def breaker(events: DataFrame, *, limit: int = 3, recover_s: int = 300) -> DataFrame:
    """(tool, ts, state) at each change of a tool's breaker; state is kept by tool.

    Opens at ``limit`` failures in a row and closes at a success or, at the next event,
    ``recover_s`` seconds after it opened. Events of one trigger are taken in time order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fails, opened = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"]):
            now = int(ts.timestamp())
            if opened and (ok or now - opened >= recover_s):
                fails, opened = 0, 0
                out.append((key[0], ts, "closed"))
            fails = 0 if ok else fails + 1
            if not opened and fails >= limit:
                opened = now
                out.append((key[0], ts, "open"))
        state.update((fails, opened))
        yield pd.DataFrame(out, columns=["tool", "ts", "state"])

    return events.groupBy("tool").applyInPandasWithState(step, "tool long, ts timestamp, state string", "fails int, opened long", "append", "NoTimeout")


def last_n(spark: SparkSession, stream: DataFrame, path: str, n: int = 1000):
    """A stream writer that keeps the newest ``n`` events at ``path``, exact after every trigger."""

    def merge(batch: DataFrame, epoch: int) -> None:
        target = f"{path}/{epoch % 2}"
        other = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{(epoch + 1) % 2}")
        there = other.getFileSystem(spark._jsc.hadoopConfiguration()).exists(other)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(other.toString())) if there else batch
        rows.dropDuplicates(["event_id"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(n).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(merge)


def conversation_sizes(turns: DataFrame, *, window_tokens: int = 128_000, share: float = 0.8) -> DataFrame:
    """(conv_id, turns, tokens, compress) of each conversation with new turns, after every trigger.

    A turn counts a quarter of its characters and four tokens; ``compress`` says that the
    conversation has reached ``share`` of the window. Two numbers are kept a conversation.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, tokens = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            tokens += int((batch["text"].fillna("").str.len() // 4 + 4).sum())
        state.update((n, tokens))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "tokens": [tokens], "compress": [tokens >= share * window_tokens]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, tokens long, compress boolean", "turns long, tokens long", "update", "NoTimeout")
