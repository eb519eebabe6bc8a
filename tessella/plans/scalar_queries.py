"""Queries that apply one group of column functions to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
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


_CJK = r"\x{4e00}-\x{9fff}"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("text_counts", """
SELECT doc_id, length(text)::BIGINT AS n_chars_all, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words,
  length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS n_dense, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g'))::BIGINT AS n_content,
  length(text) // 4 AS n_tokens FROM documents""")
def text_counts(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.chars_or_words(t, True).cast("long").alias("n_chars_all"), T.chars_or_words(t, False).cast("long").alias("n_words"), T.dense_chars(t).cast("long").alias("n_dense"), F.length(T.clean_text(t)).cast("long").alias("n_content"), T.token_estimate(t).alias("n_tokens"))


@query("text_cleaning", """
SELECT doc_id, md5(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g')) AS clean_md5,
  md5(regexp_replace(text, '[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}]', '', 'g')) AS visible_md5,
  substr(trim(regexp_replace(text, '^[0-9.]+\\s*', '')), 1, 48) AS title FROM documents""")
def text_cleaning(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(t)).alias("clean_md5"), F.md5(T.clean_invisible(t)).alias("visible_md5"), T.clean_title(t).alias("title"))


@query("html_text_rules", r"""
SELECT page_id, md5(regexp_replace(html, '(?i)\{\{[^}]*PLACEHOLDER[^}]*\}\}', '', 'g')) AS no_placeholder,
  md5(regexp_replace(regexp_replace(html, '<\?xml.*?>', '', 'g'), '(?i)<!DOCTYPE.*?>', '', 'g')) AS no_prolog,
  trim(regexp_extract(html, '(?is)^\s*<time[^>]*?>(.*?)</time>', 1)) AS page_time,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '```html\s*', '', 'g'), '```', '', 'g'), '>\s*\n\s*<', '><', 'g'), '>\s+\n', E'>\n', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS tidied FROM pages""")
def html_text_rules(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(T.drop_placeholders(h)).alias("no_placeholder"), F.md5(T.clean_xml(h)).alias("no_prolog"), T.time_tag(h)[0].alias("page_time"), F.md5(T.tidy_html(h)).alias("tidied"))


@query("query_analysis", rf"""
SELECT conv_id, turn, length(text)::BIGINT AS n,
  CASE WHEN regexp_matches(text, '[{_CJK}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[{_CJK}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language,
  (suffix(trim(text), '?') OR suffix(trim(text), '？') OR {_has("text", T.QUESTION_WORDS)}) AS question,
  CASE WHEN {_has("text", T.CONJUNCTIONS)} OR length(trim(text)) > 40 THEN 'complex' ELSE 'simple' END AS complexity,
  array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(text, '[{_CJK}]|[A-Za-z0-9]+'), lambda x: length(x) > 1)), lambda x: {{'n': -length(x), 't': x}}))[1:8], lambda s: s.t), ' ') AS keywords
FROM conversations""")
def query_analysis(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("n"), T.language(t).alias("language"), T.is_question(t).alias("question"), T.complexity(t).alias("complexity"), F.array_join(T.keywords(t), " ").alias("keywords"))


@query("url_categories", """
SELECT page_id, CASE WHEN {0} THEN '规则类' WHEN {1} THEN '操作类' WHEN {2} THEN '信息类' ELSE '泛用类' END AS category,
  substr(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 120) AS file_name FROM pages""".format(*(_has("url", w) for w, _ in T.URL_CATEGORIES)))
def url_categories(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_category(F.col("url")).alias("category"), T.file_name(F.col("url")).alias("file_name"))


@query("rewrite_skips", """
WITH n AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, (c.text IN ({0}) OR n.turns < 2) AS skip, trim(c.text) AS answer FROM conversations c JOIN n USING (conv_id) WHERE c.role = 'user'""".format(", ".join(f"'{w}'" for w in T.REWRITE_SKIP)))
def rewrite_skips(spark, d):
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.where("role = 'user'").join(n, "conv_id").select("conv_id", "turn", T.skip_rewrite(F.col("text"), F.col("turns")).alias("skip"), T.after_thinking(F.col("text")).alias("answer"))


@query("redacted_events", r"""
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(props || ' sk-' || event_id || ' Bearer  t' || user_id || ' /home/u' || user_id || '/x', 'sk-[a-zA-Z0-9]+', 'sk-***', 'g'), 'Bearer\s+[a-zA-Z0-9_\-]+', 'Bearer ***', 'g'), '(/Users/|/home/|C:\\Users\\)[^/\\]+', '\1***', 'g') AS payload FROM events""")
def redacted_events(spark, d):
    made = F.concat("props", F.lit(" sk-"), F.col("event_id"), F.lit(" Bearer  t"), F.col("user_id"), F.lit(" /home/u"), F.col("user_id"), F.lit("/x"))
    return table(spark, d, "events").select("event_id", T.redact(made).alias("payload"))


def _size_sql(n: str) -> str:
    cases = " ".join(f"WHEN {n} < {1024 ** (p + 1)} THEN printf('%.1f{u}', ({n}) / {1024**p}.0::DOUBLE)" for p, u in enumerate(["B", "KB", "MB", "GB"]))
    return f"CASE {cases} ELSE printf('%.1fTB', ({n}) / {1024**4}.0::DOUBLE) END"


@query("hashes_and_summaries", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, CASE WHEN n < 300 THEN left(text, 150) ELSE left(trim(text), 150) END AS summary,
  {_size_sql('n')} AS size, {_size_sql('n * 5000')} AS size_of_5000, {_size_sql('n * 3000000000')} AS size_of_3e9 FROM t""")
def hashes_and_summaries(spark, d):
    t, n = T.filled(F.col("text")), F.length(T.filled(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), T.summary(t).alias("summary"), T.file_size(n).alias("size"), T.file_size(n * 5000).alias("size_of_5000"), T.file_size(n * 3_000_000_000).alias("size_of_3e9"))


@query("reranker_documents", """
SELECT doc_id, md5('【页面名称】：' || trim(source) || E'\\n【段落标题】：' || trim(substr(text, 1, 48)) || E'\\n【来源路径】：' || trim('doc/' || doc_id) || E'\\n【摘要】：' || trim(left(text, 100)) || E'\\n【正文】：' || trim(text)) AS labelled,
  md5(substr(source || E'\\n' || substr(text, 1, 20) || E'\\n' || text, 1, 2000)) AS for_rerank FROM documents WHERE text <> ''""")
def reranker_documents(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(T.labelled_document(F.col("source"), F.substring(t, 1, 48), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.left(t, F.lit(100)), t)).alias("labelled"), F.md5(T.rerank_text(F.col("source"), F.substring(t, 1, 20), t)).alias("for_rerank"))


@query("observation_truncation", """
WITH p AS (SELECT doc_id, text, string_split(text, E'\\n') AS parts FROM documents)
SELECT doc_id, md5(CASE WHEN len(parts) <= 4 THEN text ELSE array_to_string(parts[1:4], E'\\n') END) AS head, md5(CASE WHEN len(parts) <= 4 THEN text ELSE array_to_string(parts[-4:], E'\\n') END) AS tail,
  md5(CASE WHEN len(parts) <= 4 THEN text ELSE array_to_string(list_concat(list_concat(parts[1:2], ['...']), parts[-2:]), E'\\n') END) AS both FROM p""")
def observation_truncation(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *(F.md5(T.truncate_lines(t, 4, 10**9, how)).alias(name) for how, name in (("head", "head"), ("tail", "tail"), ("head_tail", "both"))))


@query("label_parsing", """
WITH a AS (SELECT event_id, '文档1: ' || (event_id % 3) || ' 文档2：' || (event_id % 4) AS answer, E'---\\nname: n' || event_id || E'\\ndescription: about ' || event_type || E'\\n---\\nbody' AS skill, 'see [' || (event_id % 5) || '] and [2] [' || (event_id % 7) || ']' AS cites FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (event_id % 3) || ',' || (event_id % 4) END AS labels, 'n' || event_id AS name, regexp_extract(skill, 'description: (.*)', 1) AS description,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(cites, '\\[(\\d+)\\]', 1), lambda x: x::INT))), ',') AS cited FROM a""")
def label_parsing(spark, d):
    e = F.col("event_id")
    answer = F.concat(F.lit("文档1: "), e % 3, F.lit(" 文档2："), e % 4)
    skill = F.concat(F.lit("---\nname: n"), e, F.lit("\ndescription: about "), F.col("event_type"), F.lit("\n---\nbody"))
    cites = F.concat(F.lit("see ["), e % 5, F.lit("] and [2] ["), e % 7, F.lit("]"))
    name, about = T.front_matter(skill)
    return table(spark, d, "events").select("event_id", F.array_join(T.relevance_labels(answer, 2), ",").alias("labels"), name.alias("name"), about.alias("description"), F.array_join(T.cited(cites), ",").alias("cited"))


@query("typed_arguments", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k_long, TRY_CAST(event_type AS BIGINT) AS bad_long, strftime(to_timestamp(event_id * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at,
  TRY_CAST(TRY_STRPTIME(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) IS NULL AS unparsed FROM events""")
def typed_arguments(spark, d):
    e = F.col("event_id")
    text = F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k_long"), F.col("event_type").try_cast("long").alias("bad_long"), T.date_time(F.timestamp_seconds(e * 86400)).alias("at"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).isNull().alias("unparsed"))
