"""I-Match fingerprints: terms in an inverse-document-frequency band, hashed by random lexicon subsets.

The lexicon is every term whose document frequency lies between 1/100 and 1/5 of the
documents. A document's in-band terms, distinct and sorted, are hashed once for each of
32 random subsets of the lexicon; the fingerprint is the 32 hashes end to end. Subsets
are drawn at four rates, so that short and long documents both have subsets in which
they own a few terms. The likeness of two fingerprints is the share of equal hashes
among the subsets in which either has a term.

Size of what each task holds: a term in the band occurs in at least 1/100 of the
documents, so the lexicon has at most 100 times the mean number of distinct terms of a
document, whatever the number of documents.

Only DataFrame functions run. Defined results: a null text is the empty text; a text
without in-band terms gets a hash of the whole text as its fingerprint, like itself
alone; the document after the last is the first, in ascending doc_id with null ids first
and equal ids ordered by text; a lone document follows itself; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh_name

#: One of every so many documents at least, and at most, holds a term of the lexicon.
RAREST, COMMONEST = 100, 5
#: Each subset takes one of so many lexicon terms.
SUBSETS = [4] * 4 + [16] * 8 + [64] * 8 + [256] * 12
WORD_BREAK = r"[^\p{L}\p{N}]+"
_NONE = "--------"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats and empty strings included."""
    return F.split(F.lower(text), WORD_BREAK)


def lexicon(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The terms in the band, from counts over all documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.count()
    band = (F.col("df") * RAREST >= total) & (F.col("df") * COMMONEST <= total) & (F.col("term") != "")
    return sorted(r.term for r in found.where(band).select("term").collect())


def in_subset(term: str, number: int) -> bool:
    """Whether a term belongs to a subset, by the md5 of both."""
    return int(hashlib.md5(f"{number}:{term}".encode()).hexdigest()[:2], 16) < 256 // SUBSETS[number]


def fingerprint(text: Column, words: list[str]) -> Column:
    """The fingerprint expression for a lexicon."""
    if not words:
        return F.rpad(F.md5(text), 8 * len(SUBSETS), "-")
    members = [[w for w in words if in_subset(w, i)] for i in range(len(SUBSETS))]

    def part(own: Column, chosen: list[str]) -> Column:
        if not chosen:
            return F.lit(_NONE)
        subset = F.filter(own, lambda t: t.isin(chosen))
        return F.transform(F.array(subset), lambda s: F.when(F.size(s) == 0, _NONE).otherwise(F.substring(F.md5(F.array_join(s, " ")), 1, 8)))[0]

    own = F.array_sort(F.array_distinct(F.filter(terms(text), lambda t: t.isin(words))))
    hashed = F.transform(F.array(own), lambda ts: F.when(F.size(ts) == 0, F.lit(None).cast("string")).otherwise(F.concat(*(part(ts, m) for m in members))))[0]
    return F.coalesce(hashed, F.rpad(F.md5(text), 8 * len(SUBSETS), "-"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either fingerprint has one, 0 to 1."""
    pairs = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1)), lambda i: F.struct(F.substr(a, i * 8 + 1, F.lit(8)).alias("x"), F.substr(b, i * 8 + 1, F.lit(8)).alias("y"))),
        lambda p: (p["x"] != _NONE) | (p["y"] != _NONE),
    )
    equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(equal / F.size(pairs), F.lit(0.0)))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below ``key``, looked up in two steps of about sqrt(bounds)."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(r[0]).cast("long") for r in rows))
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in r)) for r in rows))
    coarse = F.size(F.filter(heads, lambda b: b <= key))
    fine = F.transform(F.array(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(F.get(table, c - 1), lambda b: b <= key))))[0]
    return F.when(key.isNull(), 0).otherwise(fine)


def with_next(docs: DataFrame, carried: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``next_<column>`` for each carried column, of the document that follows by id.

    Ids are dealt into ranges; the first document of each range is also sent to the range
    before it, and the very first to the last range, so one shuffle finds every follower.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, nulls, least = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull()), F.min(id_col)).first()
    ranges = min(max(2 * parts, total // 3000), 50_000)
    # some 20 ids a range, drawn by hash, place the bounds well enough: they decide where rows go, not what they get
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(9), id_col), F.lit(max(1, total // (20 * ranges)))) == 0)
    marks = drawn.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted({int(b) for b in marks} - {least})
    first = F.col(id_col).isNull() if nulls else F.col(id_col) == F.lit(least)
    bucket, wrap, extra = (fresh_name(docs.columns, c) for c in ("range", "wrap", "extra"))
    here = _bucket(F.col(id_col), bounds)
    homes = docs.withColumn(bucket, here).withColumn(
        extra,
        F.filter(
            F.array(
                F.struct(F.col(bucket).alias("range"), F.lit(0).alias("wrap"), F.lit(False).alias("extra")),
                F.when(F.col(id_col).isin(bounds) if bounds else F.lit(False), F.struct((F.col(bucket) - 1).alias("range"), F.lit(0).alias("wrap"), F.lit(True).alias("extra"))),
                F.when(first, F.struct(F.lit(len(bounds)).alias("range"), F.lit(1).alias("wrap"), F.lit(True).alias("extra"))),
            ),
            lambda s: s.isNotNull(),
        ),
    )
    dealt = homes.drop(bucket).select(*docs.columns, F.inline(extra).alias(bucket, wrap, extra))
    order = Window.partitionBy(bucket).orderBy(F.col(wrap), F.col(id_col).asc_nulls_first(), *(F.col(c) for c in carried))
    followed = dealt.select(*docs.columns, extra, *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return followed.where(~F.col(extra)).drop(extra)


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to it and to the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = lexicon(rows)
    marked = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"), words)), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    out = marked.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    out = out.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), words).alias("edited_fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all of ``documents`` and of their edited texts."""
    from tessella.session import table

    return compare_edited(table(spark, sf_dir, "documents"))


_SHARES = ", ".join(f"({i}, '{256 // d:02x}')" for i, d in enumerate(SUBSETS))
ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
followed AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 2 AS half,
    coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
  FROM docs),
texts AS (
  SELECT doc_id, 0 AS kind, text FROM docs
  UNION ALL SELECT doc_id, 1, left(text, n - half) || left(next_text, half) FROM followed),
owned AS (SELECT DISTINCT doc_id, kind, unnest(regexp_split_to_array(lower(text), '{WORD_BREAK}')) AS term FROM texts),
lex AS (
  SELECT term FROM owned WHERE kind = 0 AND term <> '' GROUP BY term
  HAVING count(*) * {RAREST} >= (SELECT count(*) FROM docs) AND count(*) * {COMMONEST} <= (SELECT count(*) FROM docs)),
subsets(number, top) AS (VALUES {_SHARES}),
members AS (SELECT number, term FROM lex, subsets WHERE substr(md5(number || ':' || term), 1, 2) < top),
banded AS (SELECT doc_id, kind, term FROM owned JOIN lex USING (term)),
owners AS (SELECT DISTINCT doc_id, kind FROM banded),
hashed AS (SELECT doc_id, kind, number, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM banded JOIN members USING (term) GROUP BY ALL),
parts AS (SELECT doc_id, kind, number, coalesce(h, '{_NONE}') AS h FROM owners CROSS JOIN subsets LEFT JOIN hashed USING (doc_id, kind, number)),
joined AS (SELECT doc_id, kind, string_agg(h, '' ORDER BY number) AS fp FROM parts GROUP BY ALL),
prints AS (SELECT doc_id, kind, text, coalesce(fp, rpad(md5(text), {8 * len(SUBSETS)}, '-')) AS fp FROM texts LEFT JOIN joined USING (doc_id, kind)),
three AS (
  SELECT f.doc_id, f.n, e.text AS edited, p.fp AS a, e.fp AS b, q.fp AS c FROM followed f
  JOIN prints p ON p.doc_id = f.doc_id AND p.kind = 0 JOIN prints e ON e.doc_id = f.doc_id AND e.kind = 1 JOIN prints q ON q.doc_id = f.next_id AND q.kind = 0),
pieces AS (SELECT doc_id, substr(a, number * 8 + 1, 8) AS x, substr(b, number * 8 + 1, 8) AS y, substr(c, number * 8 + 1, 8) AS z FROM three, subsets),
near AS (
  SELECT doc_id,
    coalesce(count(*) FILTER (WHERE x = y AND x <> '{_NONE}') / nullif(count(*) FILTER (WHERE x <> '{_NONE}' OR y <> '{_NONE}'), 0)::DOUBLE, 0) AS near_b,
    coalesce(count(*) FILTER (WHERE x = z AND x <> '{_NONE}') / nullif(count(*) FILTER (WHERE x <> '{_NONE}' OR z <> '{_NONE}'), 0)::DOUBLE, 0) AS near_c
  FROM pieces GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE ELSE near_b END AS near_edited, CASE WHEN a = c THEN 1.0::DOUBLE ELSE near_c END AS near_next
FROM three JOIN near USING (doc_id)
"""
