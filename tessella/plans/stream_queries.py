"""Stream queries, run over the events table in batch; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.session import table
from tessella.streaming import events as E

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _events(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return E.windows(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding_windows", "SELECT b - INTERVAL (s * 5) MINUTE AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events), range(3) r(s) GROUP BY ALL")
def stream_sliding_windows(spark, d):
    return E.windows(_events(spark, d), size="15 minutes", slide="5 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """
WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    return E.sessions(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_distinct", "SELECT event_id, event_type FROM events")
def stream_distinct(spark, d):
    e = _events(spark, d)
    return E.distinct_events(e.unionByName(e)).select("event_id", "event_type")


@query("stream_filter", """SELECT event_id, length(body) > 0 AS has_body, 'event: ' || event_type || E'\\ndata: ' AS sse_head, event_id AS body_id, event_type AS body_type
FROM (SELECT event_id, event_type, to_json({'event_id': event_id}) AS body FROM events WHERE event_type IN ('error', 'purchase'))""")
def stream_filter(spark, d):
    """Events of two types; numbers are written differently by engines, so the bodies are read back."""
    out = E.of_types(_events(spark, d), ["error", "purchase"])
    parts = F.from_json("json", "event_id long, event_type string, value double")
    return out.select("event_id", (F.length("json") > 0).alias("has_body"), F.regexp_extract("sse", r"(?s)^(event: \w+\ndata: )", 1).alias("sse_head"), parts["event_id"].alias("body_id"), parts["event_type"].alias("body_type"))
