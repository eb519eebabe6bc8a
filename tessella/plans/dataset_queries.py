"""Chunking, page, phrase, dataset and training-pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import chunking as C
from tessella.operators import datasets as D
from tessella.operators import pages as P
from tessella.operators import phrases as H
from tessella.session import table
from tessella.work import spread

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("chunk_documents")
def chunk_documents(spark, d):
    return C.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


@query("greedy_pack_lines", r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, E'\n')) || E'\n' AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents),
w(doc_id, i, n, cur, done) AS (
  SELECT doc_id, 1, length(line), line, '' FROM l WHERE i = 1
  UNION ALL
  SELECT w.doc_id, l.i, CASE WHEN w.n + length(line) <= 500 THEN w.n + length(line) ELSE length(line) END,
    CASE WHEN w.n + length(line) <= 500 THEN w.cur || line ELSE line END,
    CASE WHEN w.n + length(line) <= 500 THEN w.done ELSE w.done || w.cur || '|' END
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
c AS (SELECT w.doc_id, 1 + sum(CASE WHEN w.n + length(l.line) > 500 THEN 1 ELSE 0 END) AS n FROM w LEFT JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1 GROUP BY w.doc_id)
SELECT f.doc_id, c.n::INT AS n_chunks, md5(done || cur) AS chunks_md5 FROM f JOIN c USING (doc_id)""")
def greedy_pack_lines(spark, d):
    """Lines of each document packed into chunks of 500 characters by a fold in the engine."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n")))
    packed = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", C.pack_words(lines, 500).alias("c"))
    return packed.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


@query("html_clean")
def html_clean(spark, d):
    return P.clean_pages(spread(table(spark, d, "pages")))


@query("html_text")
def html_text(spark, d):
    return P.page_texts(spread(table(spark, d, "pages")))


@query("html_blocks")
def html_blocks(spark, d):
    return P.page_blocks(spread(table(spark, d, "pages")))


@query("html_documents")
def html_documents(spark, d):
    return P.page_documents(spread(table(spark, d, "pages")))


_PHRASES = r"""
s AS (SELECT unnest(regexp_split_to_array(text, '[。！？；，,.!?;:、\n\r]+')) AS s FROM documents),
u AS (SELECT regexp_extract_all(s, '[A-Za-z]+') AS u FROM s),
g AS (SELECT unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(u) - k + 1), lambda i: array_to_string(u[i:i + k], ' '))))) AS phrase FROM u WHERE len(u) >= 2),
p AS (SELECT phrase, count(*) AS freq FROM g GROUP BY phrase ORDER BY freq DESC, phrase LIMIT 500)"""


def _phrases(spark, d):
    return H.frequent_phrases(spread(table(spark, d, "documents").select("text")), F.col("text"), words=True)


@query("phrase_topk", f"WITH {_PHRASES} SELECT * FROM p")
def phrase_topk(spark, d):
    return _phrases(spark, d)


@query("phrase_longest_only", f"WITH {_PHRASES} SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE length(b.phrase) > length(a.phrase) AND contains(b.phrase, a.phrase))")
def phrase_longest_only(spark, d):
    return H.longest_only(_phrases(spark, d))


@query("phrase_freq_ratio", f"WITH {_PHRASES} SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE length(b.phrase) > length(a.phrase) AND contains(b.phrase, a.phrase) AND b.freq >= 0.8 * a.freq)")
def phrase_freq_ratio(spark, d):
    return H.frequent_ratio(_phrases(spark, d))


@query("phrase_dictionary", f"WITH {_PHRASES} SELECT phrase || ' ' || freq || ' n' AS value FROM p")
def phrase_dictionary(spark, d):
    return H.dictionary_lines(_phrases(spark, d))


#: A document's question is its first line, and the answer all the rest.
def _first_line():
    return F.split_part("text", F.lit("\n"), F.lit(1))


def _qa(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("category"), F.col("lang").alias("intent"), _first_line().alias("instruction"), F.substr("text", F.length(_first_line()) + 2).alias("response"))


_QA = "qa AS (SELECT doc_id AS pos, source AS category, lang AS intent, split_part(text, E'\\n', 1) AS instruction, substr(text, length(split_part(text, E'\\n', 1)) + 2) AS response FROM documents)"


def _blocks_sql(limit: str, least: int, normal: str, summary: int, order: str = "category, intent, pos") -> str:
    return rf"""WITH {_QA}, r AS (SELECT pos, category, intent, trim(instruction) AS i, trim(response) AS a FROM qa {limit}),
k AS (SELECT *, {normal} AS k FROM r WHERE length(i) >= {least})
SELECT pos, 'Customer Question: ' || i || E'\nSupport Answer: ' || a AS text, category || ' - ' || intent AS title, 'Customer Support - ' || category AS page_name, CASE WHEN length(a) > {summary} THEN left(a, {summary}) || '...' ELSE a END AS summary, category, intent
FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY {order}) = 1"""


_FULL = "lower(i)"
for _name in D.NAMED_PLACEHOLDERS:
    _FULL = f"replace({_FULL}, '{{{{{_name.lower()}}}}}', '')"
_FULL = f"trim(replace(replace({_FULL}, '{{{{', ''), '}}}}', ''))"


@query("qa_blocks", _blocks_sql("QUALIFY row_number() OVER (PARTITION BY category, intent ORDER BY pos) <= 50", 5, r"trim(regexp_replace(lower(i), '\{\{.*?\}\}', '', 'g'))", 100))
def qa_blocks(spark, d):
    return D.knowledge_blocks(_qa(spark, d))


@query("qa_blocks_full", _blocks_sql("", 3, _FULL, 120, "pos"))
def qa_blocks_full(spark, d):
    return D.knowledge_blocks(_qa(spark, d), per_group=None, least=3, summary=120, named=D.NAMED_PLACEHOLDERS)


@query("eval_cases", f"""WITH {_QA}, g AS (SELECT * FROM qa WHERE instruction IS NOT NULL AND response IS NOT NULL AND trim(instruction) <> ''),
f AS (SELECT category, intent, arg_min(instruction, pos) AS instruction, min(pos) AS pos FROM g GROUP BY ALL)
SELECT 'basic_' || category || '_' || intent AS id, 'basic' AS type, instruction AS query, category AS expected_category, intent AS expected_intent FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY intent) <= 3
UNION ALL (SELECT 'boundary_short_' || category || '_' || intent, 'boundary', instruction, category, intent FROM g ORDER BY length(instruction), pos LIMIT 3)
UNION ALL SELECT 'multiturn_' || category, 'multiturn', instruction, category, intent FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos) = 2""")
def eval_cases(spark, d):
    return D.evaluation_cases(_qa(spark, d))


@query("eval_cases_full", """
WITH r AS (SELECT doc_id AS pos, source AS category, lang AS intent, split_part(text, E'\\n', 1) AS instruction, trim(split_part(text, E'\\n', 1)) AS q FROM documents),
s AS (SELECT * FROM r WHERE length(instruction) <= 10 QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY pos) = 1 ORDER BY pos LIMIT 20),
l AS (SELECT * FROM r WHERE length(instruction) >= 80 QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY pos) = 1 ORDER BY pos LIMIT 20),
f AS (SELECT category, intent, arg_min(instruction, pos) AS q, min(pos) AS pos FROM r GROUP BY ALL)
SELECT 'basic_' || lpad(pos::VARCHAR, 5, '0') || '_' || category || '_' || intent AS id, 'basic' AS type, q AS query, category AS expected_category, intent AS expected_intent FROM r WHERE length(q) >= 3 QUALIFY row_number() OVER (PARTITION BY lower(q) ORDER BY pos) = 1
UNION ALL SELECT 'boundary_short_' || category || '_' || intent || '_' || lpad(pos::VARCHAR, 5, '0'), 'boundary', q, category, intent FROM s WHERE q <> ''
UNION ALL SELECT 'boundary_long_' || category || '_' || intent || '_' || lpad(pos::VARCHAR, 5, '0'), 'boundary', q, category, intent FROM l
UNION ALL SELECT 'multiturn_' || category, 'multiturn', q, category, intent FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos) = 2""")
def eval_cases_full(spark, d):
    return D.evaluation_cases_full(_qa(spark, d).drop("response"))


_RING = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
_TRIPLES = """pool AS (SELECT doc_id AS chunk_id, source AS page_name FROM documents), pos AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS page_name FROM benchmark),
shown AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents WHERE doc_id % 40 = item_id % 40),
hard AS (SELECT query_id, chunk_id FROM (SELECT pos.query_id, pool.chunk_id FROM pos JOIN pool USING (page_name)) x WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.query_id = x.query_id AND s.chunk_id = x.chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 2)"""


def _hard(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    pool = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_name"))
    pos = b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("page_name"))
    keyed = docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 40).alias("k"))
    shown = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k")).join(keyed, "k").drop("k")
    return pos, pool, shown, D.hard_negatives(pos, pool, shown)


@query("hard_negatives", f"WITH {_TRIPLES} SELECT * FROM hard")
def hard_negatives(spark, d):
    return _hard(spark, d)[3]


@query("random_negatives", rf"""WITH {_TRIPLES}, taken AS (SELECT query_id, chunk_id FROM shown UNION SELECT query_id, chunk_id FROM hard)
SELECT query_id, chunk_id FROM (SELECT DISTINCT query_id FROM pos) q, pool WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = q.query_id AND t.chunk_id = pool.chunk_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ({_RING.format('pool.chunk_id')} - {_RING.format('q.query_id')} + 4294967296) % 4294967296, chunk_id) <= 2""")
def random_negatives(spark, d):
    pos, pool, shown, hard = _hard(spark, d)
    return D.random_negatives(pos, pool, shown.unionByName(hard))


@query("pairwise_pairs", f"WITH {_TRIPLES}, p AS (SELECT query_id, min(chunk_id) AS positive FROM shown GROUP BY query_id) SELECT query_id, positive, chunk_id AS negative FROM p JOIN hard USING (query_id) UNION ALL SELECT s.query_id, positive, s.chunk_id FROM shown s JOIN p USING (query_id) WHERE s.chunk_id <> positive")
def pairwise_pairs(spark, d):
    _, _, shown, hard = _hard(spark, d)
    positive = shown.groupBy("query_id").agg(F.min("chunk_id").alias("positive"))
    others = hard.unionByName(shown).join(positive, "query_id").where("chunk_id <> positive")
    return others.select("query_id", "positive", F.col("chunk_id").alias("negative"))


@query("pointwise_pairs", f"WITH {_TRIPLES} SELECT query_id, chunk_id, CASE WHEN chunk_id = min(chunk_id) OVER (PARTITION BY query_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM shown")
def pointwise_pairs(spark, d):
    """Labels 2 and 0 over 2."""
    _, _, shown, _ = _hard(spark, d)
    best = shown.groupBy("query_id").agg(F.min("chunk_id").alias("best"))
    return shown.join(best, "query_id").select("query_id", "chunk_id", (F.when(F.col("chunk_id") == F.col("best"), 2).otherwise(0) / 2.0).alias("label"))


@query("preference_pairs", f"WITH {_TRIPLES}, p AS (SELECT query_id, min(chunk_id) AS chosen FROM shown GROUP BY query_id) SELECT query_id, chosen, chunk_id AS rejected FROM p JOIN hard USING (query_id)")
def preference_pairs(spark, d):
    _, _, shown, hard = _hard(spark, d)
    return hard.join(shown.groupBy("query_id").agg(F.min("chunk_id").alias("chosen")), "query_id").select("query_id", "chosen", F.col("chunk_id").alias("rejected"))


@query("validation_split", f"SELECT doc_id, CASE WHEN {_RING.format('doc_id')} % 100 < 10 THEN 'validation' ELSE 'train' END AS part FROM documents")
def validation_split(spark, d):
    train, held = D.split_by_hash(table(spark, d, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("validation")))
