"""Queries for event frames, edits, todo lists, id allocation, versions, training sets and typed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.operators import datasets as D
from tessella.operators import records as C
from tessella.operators import registry as G
from tessella.operators import retrieval as R
from tessella.plans.assistant_queries import _TOK, _TURNS, _answers
from tessella.plans.dataset_queries import _RING, _TRIPLES, _hard
from tessella.plans.search_queries import _CASES, _LISTS, _METRICS, _cases, _lists, _scored
from tessella.session import table
from tessella.streaming import events as E

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


@query("answer_events", rf"""
WITH {_TURNS}, e AS (SELECT conv_id, turn, a, 'url' || conv_id AS url, CASE WHEN turn % 7 = 3 THEN 'lost' END AS error, list_transform(range(0, (length(a) + 39) // 40), lambda i: substr(a, i * 40 + 1, 40)) AS d FROM p),
f AS (SELECT conv_id, turn, list_concat(
  CASE WHEN turn % 5 = 2 THEN [] ELSE [{{event: 'citations', body: to_json([{{'index': 1, page_url: url}}])::VARCHAR}}] END,
  list_transform(d, lambda x: {{event: 'answer', body: to_json({{delta: x}})::VARCHAR}}),
  CASE WHEN error IS NULL THEN [] ELSE [{{event: 'error', body: to_json({{error_code: 'RAG_INTERNAL_ERROR', message: error}})::VARCHAR}}] END,
  [{{event: 'done', body: CASE WHEN error IS NULL THEN to_json({{answer: a, backend_used: 'local'}})::VARCHAR ELSE '{{"backend_used":"error"}}' END}}]) AS s FROM e)
SELECT conv_id, turn, (i - 1)::INT AS seq, s[i].event AS event, 'event: ' || s[i].event || E'\ndata: ' || s[i].body || E'\n\n' AS frame FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM f)""")
def answer_events(spark, d):
    """Citations, pieces of 40 characters, an error now and then, and the end of each answer, as server-sent events."""
    n = F.floor((F.length("a") + 39) / 40).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substr(F.col("a"), i * 40 + 1, F.lit(40)))).otherwise(F.array().cast("array<string>"))
    sources = F.array(F.struct(F.lit(1).alias("index"), F.concat(F.lit("url"), F.col("conv_id").cast("string")).alias("page_url")))
    rows = _answers(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 5 != 2, sources).alias("citations"), pieces.alias("deltas"), F.lit("local").alias("backend"), F.when(F.col("turn") % 7 == 3, "lost").alias("error"))
    return C.answer_events(rows, ["conv_id", "turn"])


_EDITS = [("the ", "THE "), ("\n", " / ")]


@query("multi_edits", r"""
WITH c AS (SELECT doc_id, text, (length(text) - length(replace(text, 'the ', ''))) // 4 AS x, length(text) - length(replace(text, E'\n', '')) AS y FROM documents)
SELECT doc_id, CASE WHEN x = 1 AND y = 1 THEN md5(replace(replace(text, 'the ', 'THE '), E'\n', ' / ')) END AS edited_md5, CASE WHEN x <> 1 THEN 0 WHEN y <> 1 THEN 1 END AS failed, CASE WHEN x <> 1 THEN x WHEN y <> 1 THEN y END AS matches FROM c""")
def multi_edits(spark, d):
    """Two edits that must each match once, or none is made."""
    rows = table(spark, d, "documents").select("doc_id", C.multi_edit(F.col("text"), _EDITS).alias("e"))
    return rows.select("doc_id", F.md5("e.text").alias("edited_md5"), "e.failed", "e.matches")


@query("todo_reports", """
WITH t AS (SELECT user_id AS list, event_id AS place, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'lost' ELSE 'pending' END ELSE CASE WHEN user_id % 5 = 0 THEN 'completed' ELSE 'pending' END END AS status, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'task ' || event_id END AS content FROM events WHERE user_id % 5 <> 0 OR event_type IN ('purchase', 'view')),
s AS (SELECT list, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'in_progress') AS busy, count(*) FILTER (WHERE status = 'pending') AS waiting,
  min(place) FILTER (WHERE trim(content) = '' OR status = 'lost') AS bad, arg_min(CASE WHEN trim(content) = '' THEN 'content' ELSE 'status' END, place) FILTER (WHERE trim(content) = '' OR status = 'lost') AS rule,
  arg_min(content, place) FILTER (WHERE status = 'in_progress') AS current, (list(content ORDER BY place) FILTER (WHERE status = 'pending'))[1:3] AS pending FROM t GROUP BY list)
SELECT list, total, CASE WHEN busy > 1 THEN 'in_progress' ELSE rule END AS fault, CASE WHEN busy <= 1 THEN bad END AS fault_at,
  CASE WHEN done = total THEN '✅ [' || done || '/' || total || '] 所有任务已完成！' ELSE concat_ws('. ', '📋 [' || done || '/' || total || ']', '进行中: ' || current, CASE WHEN waiting > 0 THEN '待处理: ' || array_to_string(pending, '; ') END, CASE WHEN waiting > 3 THEN '还有 ' || (waiting - 3) || ' 个...' END) END AS recap FROM s""")
def todo_reports(spark, d):
    kind, e, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    status = F.when(kind == "click", "in_progress").when(kind == "purchase", "completed").when(kind == "error", F.when(e % 3 == 0, "lost").otherwise("pending")).otherwise(F.when(u % 5 == 0, "completed").otherwise("pending"))
    rows = table(spark, d, "events").where((u % 5 != 0) | kind.isin("purchase", "view"))
    todos = rows.select(u.alias("list"), e.alias("place"), status.alias("status"), F.when(e % 11 == 0, "  ").otherwise(F.concat(F.lit("task "), e.cast("string"))).alias("content"))
    return C.todo_report(todos, "list")


@query("id_allocation", """
WITH r AS (SELECT doc_id, length(text) // 500 + 1 AS num_chunks FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, sum(num_chunks) OVER (ORDER BY substr(md5(doc_id::VARCHAR), 1, 2), doc_id) AS upto FROM r)
SELECT doc_id, num_chunks, (1000 + upto - num_chunks)::BIGINT AS first_chunk, (1000 + upto - 1)::BIGINT AS last_chunk FROM s""")
def id_allocation(spark, d):
    """Ids from 1000 on, as many for each document as it has blocks."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", (F.floor(F.length("text") / 500) + 1).alias("num_chunks"))
    return C.allocate_ids(docs, "doc_id", "num_chunks", 1000)


@query("locked_updates", """
WITH h AS (SELECT c_custkey AS key, c_mktsegment AS value, c_nationkey % 3 AS version FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS key, 'new' AS value, c_custkey % 3 AS seen FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(h.key, n.key) AS key, CASE WHEN version = seen THEN n.value ELSE h.value END AS value, CASE WHEN version = seen THEN version + 1 ELSE version END AS version, CASE WHEN h.key IS NULL THEN 'NOT_FOUND' WHEN version = seen THEN 'updated' WHEN n.key IS NULL THEN 'kept' ELSE 'CONFLICT' END AS outcome FROM h FULL JOIN n ON h.key = n.key""")
def locked_updates(spark, d):
    c = table(spark, d, "customer")
    held = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), (F.col("c_nationkey") % 3).alias("version"))
    changes = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("new").alias("value"), (F.col("c_custkey") % 3).alias("seen"))
    return C.locked_update(held, changes, "key", "value")


_SETS = rf"""{_TRIPLES}, taken AS (SELECT query_id, chunk_id FROM shown UNION SELECT query_id, chunk_id FROM hard),
rnd AS (SELECT query_id, chunk_id FROM (SELECT DISTINCT query_id FROM pos) q, pool WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = q.query_id AND t.chunk_id = pool.chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ({_RING.format('pool.chunk_id')} - {_RING.format('q.query_id')} + 4294967296) % 4294967296, chunk_id) <= 2),
digest AS (SELECT doc_id AS chunk_id, md5(text) AS doc FROM documents),
cand AS (SELECT query_id, chunk_id, doc, CASE WHEN query_id % 3 > 0 OR chunk_id % 4 > 0 THEN (chunk_id % 3)::INT END AS label, chunk_id = min(chunk_id) OVER (PARTITION BY query_id) AS positive FROM shown JOIN digest USING (chunk_id)),
best AS (SELECT query_id, any_value(doc) FILTER (WHERE positive) AS positive, count(*) AS n, count(label) AS labelled FROM cand GROUP BY query_id HAVING n >= 2),
neg AS (SELECT query_id, 0 AS part, chunk_id, doc FROM hard JOIN digest USING (chunk_id) UNION ALL SELECT query_id, 1, chunk_id, doc FROM rnd JOIN digest USING (chunk_id) UNION ALL SELECT query_id, 2, chunk_id, doc FROM cand WHERE NOT positive),
uniq AS (SELECT n.query_id, b.positive, n.doc, min({{part: part, place: chunk_id}}) AS spot FROM neg n JOIN best b USING (query_id) WHERE n.doc <> b.positive GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, doc) AS nth FROM uniq)"""


def _sets(spark, d):
    pos, pool, shown, hard = _hard(spark, d)
    digest = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("doc"))
    rnd = D.random_negatives(pos, pool, shown.unionByName(hard))
    q, c = F.col("query_id"), F.col("chunk_id")
    least = shown.groupBy("query_id").agg(F.min("chunk_id").alias("least"))
    label = F.when((q % 3 > 0) | (c % 4 > 0), (c % 3).cast("int"))
    candidates = shown.join(digest, "chunk_id").join(least, "query_id").select("query_id", c.alias("place"), "doc", label.alias("label"), (c == F.col("least")).alias("positive"))
    negatives = hard.select("query_id", "chunk_id", F.lit("hard").alias("part")).unionByName(rnd.select("query_id", "chunk_id", F.lit("random").alias("part"))).join(digest, "chunk_id").select("query_id", "part", c.alias("place"), "doc")
    return C.training_sets(candidates, negatives)


@query("training_pointwise", f"WITH {_SETS} SELECT query_id, c.doc, CASE WHEN labelled = n THEN label WHEN c.positive THEN 2 ELSE 0 END AS label FROM cand c JOIN best USING (query_id) WHERE query_id IN (SELECT query_id FROM uniq)")
def training_pointwise(spark, d):
    return _sets(spark, d)[0]


@query("training_pairwise", f"WITH {_SETS} SELECT query_id, positive, doc AS negative FROM nth")
def training_pairwise(spark, d):
    return _sets(spark, d)[1]


@query("training_preference", f"WITH {_SETS} SELECT query_id, positive AS chosen, doc AS rejected FROM nth WHERE nth <= 3")
def training_preference(spark, d):
    return _sets(spark, d)[2]


@query("degraded_retrieve", f"""WITH {_LISTS}, o AS (SELECT query_id, chunk_id, score, CASE retriever WHEN 'vector' THEN 1 ELSE 2 END AS turn, rank AS r FROM lists),
f AS (SELECT query_id, chunk_id, score, turn, r FROM o QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, r) = 1)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY turn, r) AS rank FROM f QUALIFY rank <= 5""")
def degraded_retrieve(spark, d):
    """Where fusion and rerank both fail: the lists one behind the other, the first copies, cut to the first five."""
    return R.joined_lists(_lists(spark, d), ["vector", "keyword"]).where("rank <= 5")


_JUDGED = rf"""{_TURNS}, h AS (SELECT conv_id, turn, q, a, CASE WHEN turn % 4 < 3 THEN q END AS reference, [q, lag(a) OVER (PARTITION BY conv_id ORDER BY turn)] AS contexts, round(length(a) * 1.5::DOUBLE, 2) AS latency_ms FROM p),
k AS (SELECT *, list_distinct({_TOK.format('a')}) AS at_, list_distinct({_TOK.format("array_to_string(contexts, ' ')")}) AS ct, list_distinct(list_filter(string_split(replace(a, ' ', ''), ''), lambda x: x <> '')) AS ca, list_distinct(list_filter(string_split(replace(reference, ' ', ''), ''), lambda x: x <> '')) AS cr FROM h),
judged AS (SELECT conv_id, turn, len(regexp_extract_all(a, '\[(\d+)\]')) > 0 AS has_citation, len(list_filter(regexp_extract_all(a, '\[(\d+)\]', 1), lambda x: x::INT < 1 OR x::INT > 2)) = 0 AS citation_valid,
  round(CASE WHEN len(at_) = 0 OR len(ct) = 0 THEN 0 ELSE len(list_intersect(at_, ct)) / len(at_) END, 4)::DOUBLE AS grounded,
  CASE WHEN reference <> '' THEN round(CASE WHEN len(ca) = 0 OR len(cr) = 0 THEN 0 ELSE 2 * len(list_intersect(ca, cr)) / (len(ca) + len(cr)) END, 4) END::DOUBLE AS lexical_f1, latency_ms FROM k)"""


def _judged(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _answers(spark, d).withColumn("contexts", F.array("q", F.lag("a").over(w))).withColumn("reference", F.when(F.col("turn") % 4 < 3, F.col("q")))
    c = T.cited(F.col("a"))
    return rows.select("conv_id", "turn", (F.size(c) > 0).alias("has_citation"), F.forall(c, lambda x: x.between(1, 2)).alias("citation_valid"), M.groundedness_in(F.col("a"), F.col("contexts")).alias("grounded"), F.when(F.col("reference") != "", M.lexical_f1(F.col("a"), F.col("reference"))).alias("lexical_f1"), F.round(F.length("a") * 1.5, 2).alias("latency_ms"))


@query("judged_answers", f"WITH {_JUDGED} SELECT * FROM judged")
def judged_answers(spark, d):
    """Citations, groundedness in the union of contexts, and lexical F1 where there is a reference."""
    return _judged(spark, d)


@query("end_to_end_report", f"""WITH {_CASES},{_METRICS}, {_JUDGED}
SELECT * FROM (SELECT count(*) AS retrieval_cases, {", ".join(f"round(avg({m}), 4) AS {m}" for m in ("recall", "precision", "mrr", "ndcg"))} FROM scored WHERE query_id IN (SELECT query_id FROM cases WHERE len(relevant) > 0)),
(SELECT count(*) AS num_cases, round(avg(has_citation::INT), 4) AS citation_coverage, round(avg(grounded), 4) AS avg_groundedness, round(avg(lexical_f1), 4) AS avg_lexical_f1, round(avg(latency_ms), 4) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 2) AS p99_ms FROM judged)""")
def end_to_end_report(spark, d):
    """One row: retrieval over the cases that have relevant ids, generation and latency over all answers."""
    retrieval = _scored(_cases(spark, d).where(F.size("relevant") > 0)).agg(F.count("*").alias("retrieval_cases"), *(F.round(F.avg(m), 4).alias(m) for m in ("recall", "precision", "mrr", "ndcg")))
    p = lambda x: F.round(F.percentile("latency_ms", F.lit(x)), 2)
    made = _judged(spark, d).agg(F.count("*").alias("num_cases"), F.round(F.avg(F.col("has_citation").cast("int")), 4).alias("citation_coverage"), F.round(F.avg("grounded"), 4).alias("avg_groundedness"), F.round(F.avg("lexical_f1"), 4).alias("avg_lexical_f1"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))
    return retrieval.crossJoin(made)  # one row each


@query("value_counts", "SELECT 'lang' AS \"column\", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def value_counts(spark, d):
    return C.value_counts(table(spark, d, "documents"), ["lang", "source"])


@query("budgeted_lines", r"""
WITH l AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS i, unnest(string_split(text, E'\n')) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, sum(length(line) // 4) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l)
SELECT doc_id, md5(CASE WHEN length(any_value(text)) // 4 <= 200 THEN any_value(text) ELSE coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE used <= 200), '') END) AS kept_md5 FROM c GROUP BY doc_id""")
def budgeted_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.lines_within(F.col("text"), 200)).alias("kept_md5"))


_ARGS = "a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_id || '.5' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'off' END ELSE event_type END AS v, CASE user_id % 4 WHEN 0 THEN 'Number' WHEN 1 THEN 'integer' WHEN 2 THEN 'BOOL' ELSE 'string' END AS k FROM events)"


def _args(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    s = e.cast("string")
    v = F.when(e % 5 == 0, s).when(e % 5 == 1, F.concat(F.lit(" "), s, F.lit(" "))).when(e % 5 == 2, F.concat(s, F.lit(".5"))).when(e % 5 == 3, F.when(e % 2 == 0, "Yes").otherwise("off")).otherwise(F.col("event_type"))
    k = F.when(u % 4 == 0, "Number").when(u % 4 == 1, "integer").when(u % 4 == 2, "BOOL").otherwise("string")
    return table(spark, d, "events").select("event_id", v.alias("v"), k.alias("k"))


@query("coerced_arguments", rf"""WITH {_ARGS}, c AS (SELECT event_id, v, CASE WHEN k = 'Number' THEN try_cast(v AS DOUBLE) END AS number, CASE WHEN k = 'integer' AND regexp_full_match(v, '\s*[+-]?[0-9]+\s*') THEN try_cast(trim(v) AS BIGINT) END AS "integer", CASE WHEN k = 'BOOL' THEN lower(v) IN ('true', '1', 'yes') END AS flag FROM a)
SELECT event_id, number, "integer", flag, CASE WHEN number IS NULL AND "integer" IS NULL AND flag IS NULL THEN v END AS text FROM c""")
def coerced_arguments(spark, d):
    return _args(spark, d).select("event_id", F.inline(F.array(T.coerced(F.col("v"), F.col("k")))))


@query("setting_flags", f"WITH {_ARGS} SELECT event_id, CASE WHEN v <> '' THEN lower(trim(v)) IN ('1', 'true', 'yes', 'on') END AS flag FROM a")
def setting_flags(spark, d):
    return _args(spark, d).select("event_id", T.setting_flag(F.col("v")).alias("flag"))


@query("selected_answers", r"""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 3 THEN '问题：' ELSE ' 问题： how many ' || user_id || ' ' END || E'\n\n对应段编号：' || (event_id % 7) || CASE WHEN event_id % 9 = 0 THEN ' items' ELSE '' END AS t FROM events),
p AS (SELECT event_id, trim(regexp_extract(t, '问题：([^\n]*)', 1)) AS q, try_cast(regexp_extract(t, '编号[：:.)） ]*([+-]?[0-9]+)[：:.)） ]*$', 1) AS INT) - 1 AS n FROM r)
SELECT event_id, CASE WHEN q <> '' AND n BETWEEN 0 AND 4 THEN q END AS query, CASE WHEN q <> '' AND n BETWEEN 0 AND 4 THEN n END AS place FROM p""")
def selected_answers(spark, d):
    e = F.col("event_id")
    head = F.when(e % 4 == 3, "问题：").otherwise(F.concat(F.lit(" 问题： how many "), F.col("user_id").cast("string"), F.lit(" ")))
    reply = F.concat(head, F.lit("\n\n对应段编号："), (e % 7).cast("string"), F.when(e % 9 == 0, " items").otherwise(""))
    return table(spark, d, "events").select("event_id", F.inline(F.array(T.selected_answer(reply, 5))))


_CLAUSE = """'{"bool":{"should":[{"terms":{"title.keyword":["' || w || '"],"boost":6.0}}' || CASE WHEN length(w) > 1 THEN ',{"match_phrase":{"title":{"query":"' || w || '","slop":2,"boost":4.0}}}' ELSE '' END || '],"minimum_should_match":1}},{"bool":{"should":[{"terms":{"text.keyword":["' || w || '"],"boost":1.2}},{"match":{"text":{"query":"' || w || '","fuzziness":"AUTO","boost":0.5}}}' || CASE WHEN length(w) > 1 THEN ',{"match_phrase":{"text":{"query":"' || w || '","slop":2,"boost":0.8}}}' ELSE '' END || '],"minimum_should_match":1}}'"""


@query("search_bodies", rf"""
WITH k AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS ws FROM benchmark), j AS (SELECT item_id, list_sort(ws)[1:item_id % 4] AS ws FROM k)
SELECT item_id, '{{"query":' || CASE WHEN len(ws) > 0 THEN '{{"bool":{{"should":[' || array_to_string(list_transform(ws, lambda w: {_CLAUSE}), ',') || '],"minimum_should_match":"30%"}}}}' ELSE '{{"match_none":{{}}}}' END || ',"highlight":{{"fields":{{"*":{{"pre_tags":["<em>"],"post_tags":["</em>"]}}}}}}}}' AS body FROM j""")
def search_bodies(spark, d):
    """Bodies of keyword searches for up to three words, over an exact title and a text."""
    words = F.slice(F.array_sort(F.array_distinct(T.tokens(F.col("text")))), F.lit(1), (F.col("item_id") % 4).cast("int"))
    return table(spark, d, "benchmark").select("item_id", T.search_body(words, {"title": (5, False), "text": (1, True)}).alias("body"))


@query("corpus_texts", "SELECT doc_id, md5(concat_ws(' ', coalesce(source, ''), coalesce(left(text, 100), ''), '', coalesce(text, ''))) AS text_md5 FROM documents")
def corpus_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.corpus_text(F.col("source"), F.left("text", F.lit(100)), F.lit(None), F.col("text"))).alias("text_md5"))


@query("window_alerts", "WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4)::DOUBLE AS error_rate FROM events GROUP BY ALL) SELECT *, error_rate > 0.05 AS alert FROM w")
def window_alerts(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.error_rates(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("result_envelopes", """SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status, CASE event_type WHEN 'error' THEN 'INTERNAL_ERROR' END AS code, CASE WHEN event_type <> 'error' THEN props END AS data FROM events""")
def result_envelopes(spark, d):
    kind = F.col("event_type")
    code = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, "UNHEARD_OF").otherwise("INTERNAL_ERROR"))
    made = G.envelope(F.col("props"), code, kind == "signup")
    return table(spark, d, "events").select("event_id", F.inline(F.array(made)))


@query("relevance_prompts", r"""
WITH p AS (SELECT conv_id, array_agg(text ORDER BY turn) FILTER (WHERE role = 'assistant' AND turn <= 8) AS docs, arg_min(text, turn) FILTER (WHERE role = 'user') AS q FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('Question: ' || coalesce(q, '') || E'\n' || coalesce(array_to_string(list_transform(range(1, len(docs) + 1), lambda i: '文档' || i || ': ' || left(docs[i], 50)), E'\n'), '') || E'\nAnswer {0|1|2}.') AS prompt_md5 FROM p""")
def relevance_prompts(spark, d):
    """A template filled with a question and its numbered documents."""
    early = (F.col("role") == "assistant") & (F.col("turn") <= 8)
    g = table(spark, d, "conversations").where(early | (F.col("role") == "user")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(early, F.struct("turn", "text")))).alias("d"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    docs = T.numbered(F.transform("d", lambda s: s["text"]), "文档", 50)
    return g.select("conv_id", F.md5(T.from_template("Question: {q}\n{docs}\nAnswer {{0|1|2}}.", {"q": F.col("q"), "docs": docs})).alias("prompt_md5"))
