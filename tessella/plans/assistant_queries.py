"""Guardrails, prompts, pruning, tool records and other queries around answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.operators import pages as P
from tessella.operators import pruning as X
from tessella.operators import quality as Q
from tessella.operators import registry as G
from tessella.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_TOK = r"regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+')"
_TURNS = "t AS (SELECT conv_id, turn, role, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, q, a || ' [' || (turn % 3 + 1) || ']' AS a FROM t WHERE role = 'user' AND r = 'assistant')"


def _answers(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("q"), F.lead("text").over(w).alias("a"), F.lead("role").over(w).alias("r"))
    return t.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", "q", F.concat("a", F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit("]")).alias("a"))


_GUARD = rf"""WITH {_TURNS}, g AS (SELECT *, list_transform(regexp_extract_all(a, '\[(\d+)\]', 1), lambda x: x::INT) AS c, list_distinct({_TOK.format('a')}) AS at_, {_TOK.format('q')} AS qt FROM p),
s AS (SELECT conv_id, turn, len(c) > 0 AS has_citation, len(list_filter(c, lambda x: x < 1 OR x > 2)) = 0 AS valid, round(CASE WHEN len(at_) = 0 THEN 0 ELSE len(list_intersect(at_, qt)) / len(at_) END, 4)::DOUBLE AS grounded FROM g)"""


def _guarded(spark, d):
    c = T.cited(F.col("a"))
    return _answers(spark, d).select("conv_id", "turn", (F.size(c) > 0).alias("has_citation"), F.forall(c, lambda x: x.between(1, 2)).alias("valid"), M.groundedness(F.col("a"), F.col("q")).alias("grounded"))


@query("answer_guardrail", f"{_GUARD} SELECT *, concat_ws(',', CASE WHEN NOT has_citation THEN 'no_citation' END, CASE WHEN NOT valid THEN 'invalid_citation_index' END, CASE WHEN grounded < 0.12 THEN 'low_groundedness' END) AS warnings FROM s")
def answer_guardrail(spark, d):
    warn = F.concat_ws(",", F.when(~F.col("has_citation"), "no_citation"), F.when(~F.col("valid"), "invalid_citation_index"), F.when(F.col("grounded") < 0.12, "low_groundedness"))
    return _guarded(spark, d).withColumn("warnings", warn)


@query("generation_report", f"{_GUARD} SELECT count(*) AS n, round(avg(has_citation::INT), 4) AS citation_coverage, round(avg(grounded), 4) AS groundedness FROM s")
def generation_report(spark, d):
    return _guarded(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.col("has_citation").cast("int")), 4).alias("citation_coverage"), F.round(F.avg("grounded"), 4).alias("groundedness"))


@query("user_prompts", f"WITH {_TURNS} SELECT conv_id, turn, md5('【检索上下文】' || E'\\n' || a || E'\\n\\n【历史对话】\\n' || '用户：' || q || E'\\n【当前问题】\\n' || q) AS prompt_md5, CASE WHEN trim(q) = '' THEN 'none' ELSE 'vector,keyword' END AS retrievers FROM p")
def user_prompts(spark, d):
    prompt = F.concat(F.lit("【检索上下文】\n"), "a", F.lit("\n\n【历史对话】\n用户："), "q", F.lit("\n【当前问题】\n"), "q")
    return _answers(spark, d).select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"), F.when(F.trim("q") == "", "none").otherwise("vector,keyword").alias("retrievers"))


@query("answer_deltas", f"WITH {_TURNS} SELECT conv_id, turn, i::INT AS seq, substr(a, i * 40 + 1, 40) AS delta FROM (SELECT *, unnest(range(0, (length(a) + 39) // 40)) AS i FROM p)")
def answer_deltas(spark, d):
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("a") + 39) / 40).cast("int") - 1), lambda i: F.substr(F.col("a"), i * 40 + 1, F.lit(40)))
    return _answers(spark, d).where("a <> ''").select("conv_id", "turn", F.posexplode(pieces).alias("seq", "delta"))


@query("tools_in_history", r"""
WITH c AS (SELECT conv_id, text || ' Action: tool' || (turn % 3) || '[x]' AS text FROM conversations WHERE role = 'assistant'), t AS (SELECT conv_id, unnest(regexp_extract_all(text, 'Action:\s*(\w+)\[', 1)) AS tool FROM c)
SELECT conv_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM t GROUP BY conv_id""")
def tools_in_history(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", F.concat("text", F.lit(" Action: tool"), (F.col("turn") % 3).cast("string"), F.lit("[x]")).alias("text"))
    t = c.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"Action:\s*(\w+)\["), 1)).alias("tool"))
    return t.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


@query("subagent_summaries", "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS steps, sum(length(text))::BIGINT // 4 AS tokens, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def subagent_summaries(spark, d):
    says = F.col("role") == "assistant"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(says).alias("steps"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"), F.max_by("text", F.when(says, F.col("turn"))).alias("last_answer"))


@query("todo_lists", """
WITH t AS (SELECT user_id AS list, event_id AS pos, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status FROM events)
SELECT list, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) - count(*) FILTER (WHERE status = 'completed') - count(*) FILTER (WHERE status = 'in_progress') AS pending, min(pos) FILTER (WHERE status = 'in_progress') AS current, count(*) FILTER (WHERE status = 'in_progress') <= 1 AS valid FROM t GROUP BY list""")
def todo_lists(spark, d):
    status = F.when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    t = table(spark, d, "events").select(F.col("user_id").alias("list"), F.col("event_id").alias("pos"), status.alias("status"))
    n, done, now = F.count("*"), F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "in_progress")
    return t.groupBy("list").agg(n.alias("total"), done.alias("completed"), now.alias("in_progress"), (n - done - now).alias("pending"), F.min(F.when(F.col("status") == "in_progress", F.col("pos"))).alias("current"), (now <= 1).alias("valid"))


@query("tool_filters", "SELECT event_id, event_type IN ('view', 'click') AS read_only, event_type NOT IN ('error') AS allowed FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')")
def tool_filters(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").where(kind.isin("view", "click", "purchase", "error")).select("event_id", kind.isin("view", "click").alias("read_only"), (~kind.isin("error")).alias("allowed"))


@query("line_budget", """
WITH c AS (SELECT *, sum(length(line) // 4) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT doc_id, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS i, unnest(string_split(text, E'\\n')) AS line FROM documents))
SELECT doc_id, count(*) FILTER (WHERE used <= 200) AS lines_kept FROM c GROUP BY doc_id""")
def line_budget(spark, d):
    """Lines of each text from the start while their estimated tokens stay within 200."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.floor(F.length(x) / 4))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))
    fold = F.aggregate(lines, start, lambda s, n: F.struct((s["used"] + n).alias("used"), F.when(s["used"] + n <= 200, s["kept"] + 1).otherwise(s["kept"]).alias("kept")), lambda s: s["kept"])
    return table(spark, d, "documents").select("doc_id", fold.alias("lines_kept"))


@query("single_edits", "SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 AS hits, CASE WHEN (length(text) - length(replace(text, 'the ', ''))) // 4 = 1 THEN md5(replace(text, 'the ', 'THE ')) END AS edited FROM documents")
def single_edits(spark, d):
    hits = F.floor((F.length("text") - F.length(F.replace("text", F.lit("the "), F.lit("")))) / 4)
    return table(spark, d, "documents").select("doc_id", hits.alias("hits"), F.when(hits == 1, F.md5(F.replace("text", F.lit("the "), F.lit("THE ")))).alias("edited"))


@query("line_slices", "SELECT doc_id, array_to_string(string_split(text, E'\\n')[2:3], E'\\n') AS slice, len(string_split(text, E'\\n'))::BIGINT AS n_lines FROM documents WHERE len(string_split(text, E'\\n')) >= 2")
def line_slices(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").where(F.size(lines) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 2), "\n").alias("slice"), F.size(lines).cast("long").alias("n_lines"))


@query("recent_sessions", "SELECT user_id, max(ts) AS saved_at, count(*) AS events FROM events GROUP BY user_id ORDER BY saved_at DESC, user_id LIMIT 20")
def recent_sessions(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("saved_at"), F.count("*").alias("events")).orderBy(F.desc("saved_at"), "user_id").limit(20)


@query("log_statistics", "SELECT event_type AS category, count(*) AS n, max(event_id) AS latest, round(count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM events GROUP BY event_type")
def log_statistics(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.count("*").alias("total"))
    g = e.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
    return g.crossJoin(F.broadcast(total)).select("category", "n", "latest", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("schema_hashes", "SELECT p_brand AS tool, substr(sha256(string_agg(DISTINCT p_type, ',' ORDER BY p_type)), 1, 16) AS hash FROM part GROUP BY p_brand")
def schema_hashes(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("tool")).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("p_type")), ","), 256), 1, 16).alias("hash"))


@query("backend_histogram", "SELECT user_id % 10 AS backend, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id % 10 AS user_id, event_type FROM events) GROUP BY ALL) GROUP BY ALL")
def backend_histogram(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("backend"), "event_type").agg(F.count("*").alias("n"))
    return e.groupBy("backend").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", "n"))), ",").alias("histogram"))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    from tessella.operators.retrieval import cosine

    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("distinct_negatives", "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source")
def distinct_negatives(spark, d):
    return table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).distinct().groupBy("source").agg(F.count("*").alias("n"))


@query("ranked_copies", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) <= 3")
def ranked_copies(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", F.length("text").alias("n"))
    return docs.withColumn("r", Q.ranked_within(["source", "lang"], [F.desc("n"), F.col("doc_id")])).where("r <= 3").select("source", "lang", "doc_id")


@query("pruned_pages")
def pruned_pages(spark, d):
    """Each cleaned page pruned to 200 words for its own url as the query."""
    pages = P.clean_pages(table(spark, d, "pages")).join(table(spark, d, "pages").select("page_id", F.col("url").alias("query")), "page_id")
    return X.prune_pages(pages, budget=200)


@query("calculations", "SELECT event_id, round(sqrt(event_id::DOUBLE) + 8 * (user_id - 1), 6) AS value FROM events")
def calculations(spark, d):
    text = F.concat(F.lit("sqrt("), F.col("event_id"), F.lit(") + 2 ** 3 * ("), F.col("user_id"), F.lit(" - 1)"))
    return table(spark, d, "events").select("event_id", F.round(G.calculate(text), 6).alias("value"))


@query("title_similarity")
def title_similarity(spark, d):
    """Each page's title and its first heading, whole."""
    title, heading = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, d, "pages").select("page_id", F.round(G.similarity(title, heading), 6).alias("ratio"))


@query("weighted_sample", "SELECT p_partkey FROM part ORDER BY -ln((('0x' || substr(md5('42:' || p_partkey), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / p_retailprice, p_partkey LIMIT 100")
def weighted_sample(spark, d):
    return table(spark, d, "part").orderBy(G.weighted_order(F.col("p_retailprice"), F.col("p_partkey")), "p_partkey").limit(100).select("p_partkey")
