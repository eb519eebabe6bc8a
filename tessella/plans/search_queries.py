"""Retrieval, fusion, reranking and evaluation over ``benchmark`` passages as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.operators import retrieval as R
from tessella.session import table
from tessella.sources.index import index_of
from tessella.work import Workspace, spread

QUERIES, ORACLE_SQL = {}, {}
K = 5


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("title"))


_TOKENS = r"regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+')"
_KEYWORD = rf"""
ct AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM ct GROUP BY term),
cw AS (SELECT doc_id, term, tf * idf AS w FROM ct JOIN idf USING (term)),
cn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM cw GROUP BY doc_id),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT item_id, term, tf * idf AS w FROM qt JOIN idf USING (term)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY item_id),
ks AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum((qw.w / qn.n) * (cw.w / cn.n)), 6) AS score FROM qw JOIN qn USING (item_id) JOIN cw USING (term) JOIN cn USING (doc_id) GROUP BY ALL),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ks WHERE score > 0 QUALIFY rank <= 20)"""


def _cells(name: str, source: str, key: str, text: str) -> str:
    return rf"""
{name}0 AS (SELECT {key}, ('0x' || substr(h, 31, 2))::INT AS bucket, 1 - 2 * (('0x' || substr(h, 30, 1))::INT % 2) AS sign FROM (SELECT {key}, md5(unnest({_TOKENS.format(text)})) AS h FROM {source})),
{name}1 AS (SELECT {key}, bucket, sum(sign) AS v FROM {name}0 GROUP BY ALL HAVING sum(sign) <> 0),
{name} AS (SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM {name}1)"""


_VECTOR = f"""{_cells('qc', 'benchmark', 'item_id', 'text')},{_cells('dc', 'documents', 'doc_id', 'text')},
vs AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qc.value * dc.value), 6) AS score FROM qc JOIN dc USING (bucket) GROUP BY ALL),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 20)"""
_LISTS = f"""{_KEYWORD},{_VECTOR},
lists AS (SELECT 'keyword' AS retriever, * FROM keyword UNION ALL SELECT 'vector', * FROM vector)"""
_RRF = f"""{_LISTS},
fused0 AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused0)"""
_RERANK = rf"""{_RRF},
texts AS (SELECT doc_id, substr(concat_ws(E'\n', nullif(source, ''), nullif(text, '')), 1, 2000) AS t FROM documents),{_cells('rc', 'texts', 'doc_id', 't')},
rs AS (SELECT f.query_id, f.chunk_id, round(coalesce(sum(qc.value * rc.value), 0), 6) AS score FROM (SELECT * FROM fused WHERE rank <= 20) f LEFT JOIN qc ON qc.item_id = f.query_id LEFT JOIN rc ON rc.doc_id = f.chunk_id AND rc.bucket = qc.bucket GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rs QUALIFY rank <= {K})"""


def _keyword(spark, d, k=20):
    index = index_of(_corpus(spark, d))
    return R.keyword_search(_queries(spark, d), index.lists, index.idf, index.norms, k)


def _vector(spark, d, k=20):
    return R.vector_search(R.hash_vectors(_queries(spark, d), "query_id", F.col("text")), index_of(_corpus(spark, d)).vectors, k)


def _lists(spark, d):
    """Both lists, written: what reads them reads them several times."""
    a = _keyword(spark, d).withColumn("retriever", F.lit("keyword"))
    return Workspace(spark).keep(a.unionByName(_vector(spark, d).withColumn("retriever", F.lit("vector"))), "lists")


def _hybrid(spark, d):
    corpus = _corpus(spark, d).withColumn("rerank_text", T.rerank_text(F.col("title"), F.lit(""), F.col("text")))
    work = Workspace(spark)
    fused = work.keep(R.fuse(_lists(spark, d)).where("rank <= 20"), "fused")
    return work.keep(R.rerank(_queries(spark, d), fused, corpus, K), "best")


@query("keyword_search_topk", f"WITH {_KEYWORD} SELECT query_id, chunk_id, score, rank FROM keyword")
def keyword_search_topk(spark, d):
    return _keyword(spark, d).select("query_id", "chunk_id", "score", "rank")


@query("hash_embedding_cells", f"WITH {_cells('dc', 'documents', 'doc_id', 'text')} SELECT doc_id, bucket::INT AS bucket, round(value, 6) AS value FROM dc")
def hash_embedding_cells(spark, d):
    return R.hash_cells(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", F.col("text")).select("doc_id", "bucket", F.round("value", 6).alias("value"))


@query("hash_vector_topk", f"WITH {_VECTOR} SELECT query_id, chunk_id, score, rank FROM vector")
def hash_vector_topk(spark, d):
    return _vector(spark, d).select("query_id", "chunk_id", "score", "rank")


@query("vector_search_topk", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS score FROM v q, v c WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= {K}""")
def vector_search_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.vector_search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), K).select("query_id", "chunk_id", "score", "rank")


@query("rrf_fuse", f"WITH {_RRF} SELECT query_id, chunk_id, score, rank FROM fused")
def rrf_fuse(spark, d):
    return R.rrf(_lists(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query("weighted_fuse", f"""WITH {_LISTS},
scaled AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * 0.5 AS s FROM lists WINDOW w AS (PARTITION BY query_id, retriever)),
f AS (SELECT query_id, chunk_id, round(sum(s::DOUBLE), 6) AS score FROM scaled GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f""")
def weighted_fuse(spark, d):
    return R.weighted(_lists(spark, d), {"keyword": 0.5, "vector": 0.5}).select("query_id", "chunk_id", "score", "rank")


@query("hybrid_retrieve", f"WITH {_RERANK} SELECT query_id, chunk_id, score, rank FROM best")
def hybrid_retrieve(spark, d):
    return _hybrid(spark, d).select("query_id", "chunk_id", "score", "rank")


_PLACED = f"""{_RERANK}, ranked AS (SELECT b.*, d.source AS title, d.text FROM best b JOIN documents d ON d.doc_id = b.chunk_id)"""


def _placed(spark, d):
    return _corpus(spark, d).join(R.small(_hybrid(spark, d)), "chunk_id")


@query("context_assembly", rf"""WITH {_PLACED},
p AS (SELECT query_id, rank, '[' || rank || '] ' || title || E'\n' || text || E'\n' AS piece FROM ranked),
b AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p)
SELECT query_id, md5(string_agg(CASE WHEN before + length(piece) <= 3000 THEN piece ELSE left(piece, 3000 - before) || E'...\n' END, E'\n' ORDER BY rank)) AS context_md5, count(*) AS n_included FROM b WHERE before < 3000 GROUP BY query_id""")
def context_assembly(spark, d):
    return R.assemble_context(_placed(spark, d), 3000).select("query_id", F.md5("context").alias("context_md5"), "n_included")


@query("extractive_answer", rf"""WITH {_PLACED},
l AS (SELECT query_id, rank, replace(trim(text), E'\n', ' ') AS flat, title FROM ranked)
SELECT query_id, md5('根据知识库检索结果，为您找到以下 ' || count(*) || ' 条相关信息：' || E'\n' || string_agg('[' || rank || '] ' || title || '：' || CASE WHEN length(flat) > 200 THEN left(flat, 200) || '...' ELSE flat END, E'\n' ORDER BY rank) || E'\n' || '（以上内容直接摘录自知识库，未经 LLM 润色；如需更完整的智能问答，请部署生成模型服务）') AS answer_md5 FROM l GROUP BY query_id""")
def extractive_answer(spark, d):
    return R.extractive_answer(_placed(spark, d)).select("query_id", F.md5("answer").alias("answer_md5"))


@query("citations", rf"WITH {_PLACED} SELECT query_id, rank AS index, title, round(score, 4) AS score FROM ranked")
def citations(spark, d):
    return _placed(spark, d).select("query_id", F.col("rank").alias("index"), "title", F.round("score", 4).alias("score"))


_CASES = f"""{_KEYWORD},
found AS (SELECT query_id, list(chunk_id ORDER BY rank) AS found FROM keyword GROUP BY query_id),
rel AS (SELECT item_id AS query_id, list(doc_id) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
cases AS (SELECT b.item_id AS query_id, coalesce(found, []) AS found, coalesce(relevant, []) AS relevant FROM benchmark b LEFT JOIN found ON found.query_id = b.item_id LEFT JOIN rel ON rel.query_id = b.item_id)"""
_METRICS = """
scored AS (SELECT query_id,
  round(CASE WHEN len(relevant) = 0 THEN 0 ELSE len(list_intersect(found[1:5], relevant)) / len(list_distinct(relevant)) END, 4)::DOUBLE AS recall,
  round(CASE WHEN len(found) = 0 THEN 0 ELSE len(list_filter(found[1:5], lambda x: list_contains(relevant, x))) / len(found[1:5]) END, 4)::DOUBLE AS precision,
  round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_contains(relevant, found[i]) THEN i END), lambda i: i IS NOT NULL)), 0), 4) AS mrr,
  round(CASE WHEN len(relevant) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(found[1:5]) + 1), lambda i: CASE WHEN list_contains(relevant, found[i]) THEN 1.0::DOUBLE / log2(i + 1) ELSE 0 END)), 0) / list_sum(list_transform(range(1, least(len(list_distinct(relevant)), 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END, 4)::DOUBLE AS ndcg FROM cases)"""


def _cases(spark, d):
    found = _keyword(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("f")).select("query_id", F.transform("f", lambda s: s["chunk_id"]).alias("found"))
    b, docs = _queries(spark, d), _corpus(spark, d)
    rel = R.containing(b, spread(docs.select("chunk_id", "text")), index_of(docs).idf).groupBy("query_id").agg(F.collect_set("chunk_id").alias("relevant"))
    none = F.array().cast("array<bigint>")
    return b.join(found, "query_id", "left").join(rel, "query_id", "left").select("query_id", F.coalesce("found", none).alias("found"), F.coalesce("relevant", none).alias("relevant"))


def _scored(cases):
    f, r = F.col("found"), F.col("relevant")
    return cases.select("query_id", M.recall_at_k(f, r, K).alias("recall"), M.precision_at_k(f, r, K).alias("precision"), M.reciprocal_rank(f, r).alias("mrr"), M.ndcg_at_k(f, r, K).alias("ndcg"))


@query("retrieval_metrics", f"WITH {_CASES},{_METRICS} SELECT * FROM scored")
def retrieval_metrics(spark, d):
    return _scored(_cases(spark, d))


@query("retrieval_report", f"WITH {_CASES},{_METRICS} SELECT count(*) AS n, " + ", ".join(f"round(coalesce(avg({m}), 0), 4) AS {m}" for m in ("recall", "precision", "mrr", "ndcg")) + " FROM scored")
def retrieval_report(spark, d):
    return _scored(_cases(spark, d)).agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in ("recall", "precision", "mrr", "ndcg")))


@query("hit_rates", f"""WITH {_KEYWORD},
hits AS (SELECT b.item_id, 'src' || (b.item_id % 20) AS category, CASE WHEN length(b.text) < 200 THEN 'boundary' ELSE 'basic' END AS type, max(CASE WHEN k.rank <= 5 AND contains(d.source, 'src' || (b.item_id % 20)) THEN 1 ELSE 0 END) AS hit
  FROM benchmark b LEFT JOIN keyword k ON k.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = k.chunk_id GROUP BY ALL)
SELECT category, type, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 4) AS rate FROM hits GROUP BY GROUPING SETS ((), (category), (type))""")
def hit_rates(spark, d):
    category = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    cases = table(spark, d, "benchmark").select("item_id", category.alias("category"), F.when(F.length("text") < 200, "boundary").otherwise("basic").alias("type"))
    found = _keyword(spark, d, K).join(_corpus(spark, d).select("chunk_id", "title"), "chunk_id")
    hit = F.max(F.coalesce(F.contains("title", F.col("category")).cast("int"), F.lit(0)))
    hits = cases.join(found, cases["item_id"] == found["query_id"], "left").groupBy("item_id", "category", "type").agg(hit.alias("hit"))
    return hits.groupingSets([[], ["category"], ["type"]], "category", "type").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("hit"), 4).alias("rate"))


@query("lexical_f1", """
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, list_distinct(string_split(replace(next_text, ' ', ''), '')) AS a, list_distinct(string_split(replace(text, ' ', ''), '')) AS b, regexp_extract_all(next_text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+') AS at_, regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+') AS bt_ FROM t WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END, 4)::DOUBLE AS f1,
  round(CASE WHEN len(at_) = 0 THEN 0 ELSE len(list_intersect(list_distinct(at_), bt_)) / len(list_distinct(at_)) END, 4)::DOUBLE AS grounded FROM s""")
def lexical_f1(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    t = t.where("role = 'user' and next_role = 'assistant'")
    return t.select("conv_id", "turn", M.lexical_f1(F.col("answer"), F.col("text")).alias("f1"), M.groundedness(F.col("answer"), F.col("text")).alias("grounded"))


@query("dpo_loss", """
WITH x AS (SELECT event_id, value / 100 AS pc, value / 150 AS pr, value / 120 AS rc, value / 130 AS rr FROM events),
m AS (SELECT event_id, 0.1 * ((-ln(1 + exp(-pc)) + ln(1 + exp(-pr))) - (-ln(1 + exp(-rc)) + ln(1 + exp(-rr)))) AS m, pc > pr AS better FROM x)
SELECT count(*) AS n, round(avg(ln(1 + exp(-m))), 6) AS loss, round(avg(better::INT), 6) AS accuracy FROM m""")
def dpo_loss(spark, d):
    v = F.col("value")
    rows = table(spark, d, "events").select(M.dpo_margin(v / 100, v / 150, v / 120, v / 130, 0.1).alias("m"), (v / 100 > v / 150).cast("int").alias("better"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(-M.log_sigmoid(F.col("m"))), 6).alias("loss"), F.round(F.avg("better"), 6).alias("accuracy"))
