"""Duplicates, quality, lifecycle, dialogue and monitoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import knowledge as K
from tessella.operators import quality as Q
from tessella.session import table
from tessella.work import spread

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_CLEAN = r"lower(regexp_replace(text, '[^\x{4e00}-\x{9fa5}a-zA-Z0-9]', '', 'g'))"


@query("dedup_exact_latest", f"""
SELECT doc_id, source FROM documents QUALIFY {_CLEAN} = '' OR row_number() OVER (PARTITION BY {_CLEAN} ORDER BY doc_id % 7 DESC, doc_id) = 1""")
def dedup_exact_latest(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    return Q.dedup_latest(docs, text=F.col("text"), newest=F.timestamp_seconds(F.col("doc_id") % 7), position=F.col("doc_id")).select("doc_id", "source")


@query("dedup_by_key", """
SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY CASE WHEN event_id % 3 > 0 THEN 'i' || (event_id % 500) ELSE 't' || sha256(event_type) END ORDER BY event_id) = 1""")
def dedup_by_key(spark, d):
    idx = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 500).otherwise(-1)
    none = F.lit(None).cast("string")
    return Q.dedup_first(table(spark, d, "events"), Q.block_key(idx, F.col("event_type"), none, none), F.col("event_id")).select("event_id")


@query("quality_report", r"""
WITH t AS (SELECT regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE t = '') AS empty, count(*) FILTER (WHERE t <> '') AS filled, count(DISTINCT CASE WHEN t <> '' THEN t END) AS texts, coalesce(avg(CASE WHEN t <> '' THEN length(t) END), 0) AS mean,
  count(*) FILTER (WHERE t <> '' AND regexp_matches(t, '</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^>]*)?>')) AS html FROM t)
SELECT total, CASE WHEN total = 0 THEN 1.0 ELSE round(empty / total, 4) END::DOUBLE AS empty_ratio, CASE WHEN filled = 0 THEN 0 ELSE round((filled - texts) / filled, 4) END::DOUBLE AS duplicate_ratio, round(mean, 1) AS avg_length, html AS html_leftover_count,
  NOT (total = 0 OR round(empty / total, 4) > 0.2 OR round((filled - texts) / filled, 4) > 0.3 OR mean < 5 OR html > 0) AS passed FROM s""")
def quality_report(spark, d):
    return Q.report(spread(table(spark, d, "documents").select("text")), F.col("text"))


@query("upsert_and_delete", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 1 AND (-o_orderkey) % 11 <> 0""")
def upsert_and_delete(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("new").alias("status")).unionByName(o.where("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status")))
    merged = K.upsert(old, new, "o_orderkey")
    return K.delete_where(merged, merged.where("o_orderkey % 11 = 0"), "o_orderkey")


@query("sync_plan", """
WITH f AS (SELECT page_id AS doc_id, substr(sha256(html), 1, 16) AS hash FROM pages WHERE page_id % 5 <> 0), v AS (SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE substr(sha256(html), 1, 16) END AS latest FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(f.doc_id, v.doc_id) AS doc_id, CASE WHEN hash IS NULL THEN 'delete' WHEN latest IS NULL THEN 'ingest' WHEN hash = latest THEN 'skip_unchanged' ELSE 'reingest' END AS action FROM f FULL JOIN v ON f.doc_id = v.doc_id""")
def sync_plan(spark, d):
    p = table(spark, d, "pages")
    h = T.content_hash(F.col("html"))
    files = p.where("page_id % 5 <> 0").select(F.col("page_id").alias("doc_id"), h.alias("hash"))
    known = p.where("page_id % 4 <> 0").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 == 0, "old").otherwise(h).alias("latest_hash"))
    return K.sync_plan(files, known, prune=True)


_CRAWL = """WITH o AS (SELECT page_id AS id, page_id % 10 AS at FROM pages WHERE page_id % 6 <> 0), l AS (SELECT page_id AS id, page_id % 7 AS at FROM pages WHERE page_id % 5 <> 0),
a AS (SELECT coalesce(o.id, l.id) AS article_id, CASE WHEN o.at IS NULL THEN 'deleted' WHEN l.at IS NULL THEN 'new' WHEN o.at > l.at THEN 'update' ELSE 'skip' END AS action FROM o FULL JOIN l ON o.id = l.id)"""


def _crawl(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    return K.crawl_plan(p.where(i % 6 != 0).select(i.alias("article_id"), (i % 10).alias("online_at")), p.where(i % 5 != 0).select(i.alias("article_id"), (i % 7).alias("local_at")))


@query("crawl_diff", f"{_CRAWL} SELECT * FROM a")
def crawl_diff(spark, d):
    return _crawl(spark, d)


@query("crawl_stats", f"{_CRAWL} SELECT action, count(*) AS n FROM a GROUP BY action")
def crawl_stats(spark, d):
    return _crawl(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("version_history_lastn", "SELECT user_id AS doc_id, event_id AS version, substr(sha256(props), 1, 16) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def version_history_lastn(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.col("ts").alias("created_at"), T.content_hash(F.col("props")).alias("hash"))
    return K.last_versions(e, 5).select("doc_id", "version", "hash")


@query("latest_version", "SELECT user_id AS doc_id, count(*) AS versions, arg_max(event_id, {'t': ts, 'e': event_id}) AS latest FROM events GROUP BY user_id")
def latest_version(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("versions"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("registry", """
SELECT source AS doc_id, count(*) AS num_chunks, min(doc_id) AS first_chunk, max(doc_id) AS last_chunk, max(doc_id) + 1 AS next_id FROM documents GROUP BY source""")
def registry(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("num_chunks"), F.min("doc_id").alias("first_chunk"), F.max("doc_id").alias("last_chunk"), (F.max("doc_id") + 1).alias("next_id"))


@query("history_compression", """
WITH r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), m AS (SELECT *, max(r) OVER (PARTITION BY conv_id) AS rs FROM r)
SELECT conv_id, turn, role, text FROM m WHERE rs <= 2 OR r > rs - 2
UNION ALL SELECT conv_id, -1, 'summary', printf('%d rounds: %d user, %d assistant, %d messages', u, u, a, n) FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) AS n FROM conversations GROUP BY conv_id) WHERE u > 2""")
def history_compression(spark, d):
    return K.compress_history(table(spark, d, "conversations"), 2)


@query("dialogue_text", """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '系统' END || '：' || trim(replace(text, E'\\n', ' ')), E'\\n' ORDER BY turn) || E'\\n' AS history,
  count(*) FILTER (WHERE role = 'user') AS rounds, array_to_string(list(turn ORDER BY turn) FILTER (WHERE role = 'user'), ',') AS boundaries, sum(length(text) // 4 + 4)::BIGINT AS n_tokens, sum(length(text))::BIGINT // 4 AS chars_tokens,
  string_agg('[' || role || '] ' || left(text, 500), E'\\n' ORDER BY turn) AS log FROM conversations GROUP BY conv_id""")
def dialogue_text(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("系统"), F.lit("："), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))))
    log = F.concat(F.lit("["), "role", F.lit("] "), F.left("text", F.lit(500)))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"), log.alias("g"), (F.col("role") == "user").alias("u"))))
    g = c.groupBy("conv_id").agg(rows.alias("r"), F.count_if(F.col("role") == "user").alias("rounds"), F.sum(T.token_estimate(F.col("text")) + 4).cast("long").alias("n_tokens"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("chars_tokens"))
    users = F.transform(F.filter("r", lambda s: s["u"]), lambda s: s["turn"].cast("string"))
    return g.select("conv_id", F.concat(F.array_join(F.transform("r", lambda s: s["l"]), "\n"), F.lit("\n")).alias("history"), "rounds", F.when(F.size(users) > 0, F.array_join(users, ",")).alias("boundaries"), "n_tokens", "chars_tokens", F.array_join(F.transform("r", lambda s: s["g"]), "\n").alias("log"))


@query("history_packet", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def history_packet(spark, d):
    return table(spark, d, "conversations").withColumn("n", Q.ranked_within(["conv_id"], [F.desc("turn")])).where("n <= 10").select("conv_id", "turn", "role")


_PACKETS = """
WITH q AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(q), ' '), lambda x: x <> '')) AS qt, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS ct FROM conversations JOIN q USING (conv_id)),"""


@query("packet_relevance", _PACKETS + """
s AS (SELECT conv_id, turn, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, ct)) / len(qt) END AS rel FROM p)
SELECT conv_id, turn, round(0.7 * rel + 0.3 * exp(-(turn * 600) / 3600.0), 6)::DOUBLE AS score FROM s WHERE rel >= 0.3""")
def packet_relevance(spark, d):
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), " "), lambda w: w != ""))
    a, b = words("q"), words("text")
    rel = F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return c.join(q, "conv_id").withColumn("rel", rel).where("rel >= 0.3").select("conv_id", "turn", F.round(0.7 * F.col("rel") + 0.3 * F.exp(-(F.col("turn") * 600) / 3600.0), 6).alias("score"))


@query("greedy_prune", """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 97 DESC, turn) AS i FROM conversations),
g(conv_id, i, total, kept) AS (
  SELECT conv_id, i, w, [turn] FROM r WHERE i = 1
  UNION ALL SELECT g.conv_id, r.i, CASE WHEN g.total + r.w <= 600 THEN g.total + r.w ELSE g.total END, CASE WHEN g.total + r.w <= 600 THEN list_append(g.kept, r.turn) ELSE g.kept END FROM g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1)
SELECT conv_id, array_to_string(list_sort(kept), ',') AS kept FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def greedy_prune(spark, d):
    """Budgeted choice of a conversation's turns by length, with a skip-over budget."""
    items = F.collect_list(F.struct(F.col("turn").alias("idx"), F.length("text").alias("words"), (F.length("text") % 97).cast("double").alias("score")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(items.alias("items"))
    return g.select("conv_id", F.array_join(K.greedy_budget(F.col("items"), 600), ",").alias("kept"))


@query("event_islands", """
WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM s""")
def event_islands(spark, d):
    return K.islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "island")


@query("breaker_states", """
WITH e AS (SELECT user_id % 20 AS tool, ts, event_id AS seq, event_type <> 'error' AS ok FROM events), g AS (SELECT tool, max(CASE WHEN ok THEN {'t': ts, 's': seq} END) AS good FROM e GROUP BY tool),
f AS (SELECT e.tool, count(*) AS failures, max(ts) AS failed FROM e JOIN g ON e.tool = g.tool WHERE NOT ok AND (good IS NULL OR {'t': ts, 's': seq} > good) GROUP BY e.tool),
j AS (SELECT g.tool, coalesce(failures, 0) AS failures, floor((SELECT epoch(max(ts)) FROM e))::BIGINT - floor(epoch(failed))::BIGINT AS age FROM g LEFT JOIN f ON g.tool = f.tool)
SELECT tool, failures, CASE WHEN failures >= 3 AND age < 300 THEN 'open' ELSE 'closed' END AS state, CASE WHEN failures >= 3 AND age < 300 THEN 300 - age ELSE 0 END::BIGINT AS recover_in FROM j""")
def breaker_states(spark, d):
    return K.breaker_states(table(spark, d, "events").select((F.col("user_id") % 20).alias("tool"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))


_SNAP = """SELECT count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate, round(avg(value), 2) AS avg_ms, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99,
  round(count(*) FILTER (WHERE event_type = 'click') / count(*), 4) AS fallback_rate, round(count(*) / sum(value) * 1000, 4) AS qps FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)"""


def _snapshot(spark, d):
    last = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 2)
    share = lambda kind: F.round(F.count_if(F.col("event_type") == kind) / F.count("*"), 4)
    return last.agg(F.count("*").alias("n"), share("error").alias("error_rate"), F.round(F.avg("value"), 2).alias("avg_ms"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), share("click").alias("fallback_rate"), F.round(F.count("*") / F.sum("value") * 1000, 4).alias("qps"))


@query("monitoring_snapshot", _SNAP)
def monitoring_snapshot(spark, d):
    return _snapshot(spark, d)


@query("alerts", f"""WITH s AS ({_SNAP}), u AS (UNPIVOT (SELECT error_rate::DOUBLE AS error_rate, p95::DOUBLE AS p95, fallback_rate::DOUBLE AS fallback_rate FROM s) ON error_rate, p95, fallback_rate INTO NAME metric VALUE value),
t(metric, most, level) AS (VALUES ('error_rate', 0.05::DOUBLE, 'critical'), ('p95', 2000.0, 'warning'), ('fallback_rate', 0.8, 'warning'))
SELECT metric, value, most, level FROM u JOIN t USING (metric) WHERE value > most""")
def alerts(spark, d):
    # Limit and level of each metric.
    limits = [("error_rate", 0.05, "critical"), ("p95", 2000.0, "warning"), ("fallback_rate", 0.8, "warning")]
    long = _snapshot(spark, d).select(*(F.col(m).cast("double") for m, _, _ in limits)).unpivot([], [m for m, _, _ in limits], "metric", "value")
    return long.join(F.broadcast(spark.createDataFrame(limits, "metric string, most double, level string")), "metric").where("value > most").select("metric", "value", "most", "level")


@query("latency_percentiles", """
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round((list(value ORDER BY value))[floor(count(*) * 0.95)::INT + 1], 4) AS nearest95 FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    """Interpolated and nearest-rank percentiles; the nearest rank comes from ranks, not from a gathered list."""
    e = table(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 2).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 2).alias("p95"))
    values = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("value")
    upto = values.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = upto.join(n.select("event_type", "n"), "event_type").where(F.col("upto") > F.floor(F.col("n") * 0.95)).groupBy("event_type").agg(F.round(F.min("value"), 4).alias("nearest95"))
    return n.join(near, "event_type")


@query("trace_stats", """
SELECT user_id AS session_id, max(event_id) AS last_step, count(*) FILTER (WHERE event_type = 'view') AS model_calls, sum((json_extract_string(props, '$.k'))::BIGINT) FILTER (WHERE event_type = 'view')::BIGINT AS tokens, count(*) FILTER (WHERE event_type = 'error') AS errors, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM events GROUP BY user_id""")
def trace_stats(spark, d):
    kind = F.col("event_type")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("event_id").alias("last_step"), F.count_if(kind == "view").alias("model_calls"), F.sum(F.when(kind == "view", F.get_json_object("props", "$.k").cast("long"))).alias("tokens"), F.count_if(kind == "error").alias("errors"), (F.max(at) - F.min(at)).alias("seconds"))


@query("corpus_stats", """
SELECT (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT lang) FROM documents) AS intents, (SELECT count(*) FROM conversations) AS messages""")
def corpus_stats(spark, d):
    a = table(spark, d, "documents").agg(F.count_distinct("source").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("lang").alias("intents"))
    return a.crossJoin(table(spark, d, "conversations").agg(F.count("*").alias("messages")))


@query("array_overlap", "SELECT event_id FROM events WHERE list_has_any([event_type, 'x' || (event_id % 5)], ['error', 'x3'])")
def array_overlap(spark, d):
    tags = F.array(F.col("event_type"), F.concat(F.lit("x"), F.col("event_id") % 5))
    return table(spark, d, "events").where(F.arrays_overlap(tags, F.array(F.lit("error"), F.lit("x3")))).select("event_id")


@query("menu_paths", """
WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
walk AS (SELECT id, name AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.path || '/' || t.name FROM tree t JOIN walk w ON t.parent = w.id)
SELECT id, path FROM walk WHERE id NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)""")
def menu_paths(spark, d):
    """Leaves of a tree with their paths, by a recursive query."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    tree = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    return spark.sql("WITH RECURSIVE walk AS (SELECT id, name AS path FROM {tree} WHERE parent IS NULL UNION ALL SELECT t.id, concat(w.path, '/', t.name) FROM {tree} t JOIN walk w ON t.parent = w.id) SELECT w.id, w.path FROM walk w LEFT ANTI JOIN {tree} c ON c.parent = w.id", tree=tree)


@query("set_operations", "SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT SELECT s_nationkey, 'none' FROM supplier)")
def set_operations(spark, d):
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    sk = s.select(F.col("s_nationkey").alias("k"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(sk).withColumn("kind", F.lit("both"))
    return both.unionByName(n.select(F.col("n_nationkey").alias("k")).exceptAll(sk.distinct()).withColumn("kind", F.lit("none")))
