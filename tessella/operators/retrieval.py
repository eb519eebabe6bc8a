"""Retrieval over a table of queries: postings, TF-IDF, hash embedding, top-k, fusion, rerank.

Everything takes and returns DataFrames, a row a query and candidate, so one plan serves
any number of queries. The query set is the small side and is never assumed to fit: it is
taken in blocks. A block meets the corpus where its rows are: every task scores its own
documents and keeps the k best of each query, so that neither (document, term) rows nor
(query, document) rows are shuffled. The winners of the tasks meet in a top-k of two steps,
first within slices of the candidates and then over the slices' winners.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.work import small_batches

DIMENSIONS = 256
SLICES = 32
#: Of a block of queries: rows, terms; of a batch within a task: scores held at once, characters of text read at once.
BLOCK_ROWS, BLOCK_TERMS, CELLS, CHARS = 4096, 1 << 18, 4 << 20, 1 << 20
#: Tables of this many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 300_000
#: Terms in one of so many documents are frequent: their number is at most this times the mean number of distinct terms of a document.
FREQUENT = 4000


def top_k(scored: DataFrame, k: int, *, by: str = "query_id", order: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best of each query with their rank; ties by ascending id."""
    best = [F.col(order).desc(), F.col(tie).asc()]
    part = Window.partitionBy(by, "_slice").orderBy(*best)
    sliced = scored.withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(SLICES)))
    few = sliced.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_slice", "_n")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best)).cast("long")).where(F.col("rank") <= k)


def term_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf)"""
    return df.select(key, F.explode(T.tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def in_slices(sizes: list[int] | np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose sizes sum up to ``most``, or single rows."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > begin:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, terms, tfs) of batches of (key, text); texts without a term have no row."""
    find = re.compile(T.TOKEN).findall
    for batch in batches:
        for rows in in_slices(pc.utf8_length(batch.column(1)).to_pylist(), CHARS):
            part = batch.slice(rows.start, rows.stop - rows.start)
            each = [Counter(find(text)) for text in part.column(1).to_pylist()]
            full = np.array([i for i, c in enumerate(each) if c], dtype=np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(each[i]) for i in full])]), pa.int32())
            terms, tfs = pa.array([t for c in each for t in c], pa.string()), pa.array([n for c in each for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)], names=["key", "terms", "tfs"])


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The keys that several rows of ``df`` have."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_again"))


def term_lists(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, terms, tfs): :func:`term_counts` with a row a key, counted where the texts are.

    Rows of one key are one text; only keys that repeat are gathered.
    """
    small_batches(df.sparkSession)
    rows = df.select(key, T.filled(text).alias("_text"))
    kind = f"{key} {df.schema[key].dataType.simpleString()}, terms array<string>, tfs array<bigint>"
    again = repeated(df, key)
    if again.isEmpty():
        return rows.mapInArrow(_lists, kind)
    same = F.col(key).eqNullSafe(F.col("_again"))
    several = term_counts(rows.join(again, same, "left_semi"), key, F.col("_text")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("c"))
    return rows.join(again, same, "left_anti").mapInArrow(_lists, kind).unionByName(several.select(key, F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs")))


def counts_of_lists(lists: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of :func:`term_lists`."""
    return lists.select(key, F.inline(F.arrays_zip("terms", "tfs"))).toDF(key, "term", "tf")


def norm_parts(lists: DataFrame, idf: DataFrame, *, id_col: str = "chunk_id") -> tuple[DataFrame, int]:
    """(id, s, terms, tfs), and a number of documents: s sums (tf * idf) ** 2 over a document's terms in at least so many, terms and tfs are its others.

    ``lists`` and ``idf`` are stored tables. The frequent terms, which most rows are of, travel
    in the plan; there are ``BROADCAST_ROWS`` of them at most.
    """
    small_batches(lists.sparkSession)
    least = max(2, lists.count() // FREQUENT)
    while idf.where(F.col("df") >= least).count() > BROADCAST_ROWS:
        least *= 2
    found = idf.where(F.col("df") >= least).select("term", "idf").toArrow()
    known, value = found.column("term").combine_chunks(), np.append(found.column("idf").to_numpy(), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pc.index_in(batch.column(1).flatten(), value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)
            tf = batch.column(2).flatten()
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            s = np.bincount(row, np.square(tf.to_numpy(zero_copy_only=False) * value[place]), minlength=batch.num_rows)
            rare = place == len(known)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=batch.num_rows))]), pa.int32())
            rest = (pa.ListArray.from_arrays(ends, x.filter(pa.array(rare))) for x in (batch.column(1).flatten(), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *rest], names=["key", "s", "terms", "tfs"])

    kind = f"{id_col} {lists.schema[id_col].dataType.simpleString()}, s double, terms array<string>, tfs array<bigint>"
    return lists.mapInArrow(run, kind), least


def norms_of(parts: DataFrame, idf: DataFrame, least: int, *, id_col: str = "chunk_id") -> DataFrame:
    """(id, norm): the length of each document's tf * idf, from the stored result of :func:`norm_parts`; only rare terms are shuffled."""
    w = F.col("tf") * F.col("idf")
    rare = counts_of_lists(parts, id_col).join(idf.where(F.col("df") < least).select("term", "idf"), "term").select(id_col, (w * w).alias("s"))
    return parts.select(id_col, "s").unionByName(rare).groupBy(id_col).agg(F.sqrt(F.sum("s")).alias("norm"))


def idf_of(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf): idf is ln((1 + n) / (1 + df)) + 1 over all documents."""
    n = corpus.agg(F.count("*").alias("n"))
    found = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return found.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def postings_of(counts: DataFrame, idf: DataFrame, *, id_col: str = "chunk_id") -> DataFrame:
    """(id, term, weight) with weights tf * idf, unit length a document."""
    weighted = counts.join(idf.select("term", "idf"), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_index(corpus: DataFrame, *, id_col: str = "chunk_id", text: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, weight) and (term, idf), unstored; :mod:`tessella.sources.index` stores them."""
    counts = term_counts(corpus, id_col, F.col("text") if text is None else text)
    idf = idf_of(counts, corpus)
    return postings_of(counts, idf, id_col=id_col), idf.select("term", "idf")


class _Best:
    """The k best of each query so far among the rows that a task has seen; ties by ascending id."""

    def __init__(self, n: int, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.least = np.full(n, floor)
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row a query and a column an id; scores below the floor do not count."""
        least = self.least
        if scores.shape[1] > self.k and (least == self.floor).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        q, ids, scores = np.concatenate([self.q, q]), np.concatenate([self.ids, ids[d]]), np.concatenate([self.scores, scores[q, d]])
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.q, self.ids, self.scores = q[place < self.k], ids[keep], scores[keep]
        last = place == self.k - 1
        self.least[q[last]] = scores[order[last]]

    def batch(self, names: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(self.q)), pa.array(self.ids), pa.array(self.scores)], names=["query_id", "chunk_id", "score"])


def _matched(known: pa.Array):
    """A kernel from (id, terms, tfs) to (id, places, weights): the places in ``known`` of the terms that it has; documents without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pc.index_in(batch.column(1).flatten(), value_set=known)
            hit = place.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            n = np.bincount(row[hit], minlength=batch.num_rows)
            full = np.flatnonzero(n)
            ends = pa.array(np.concatenate([[0], np.cumsum(n[full])]), pa.int32())
            tf = batch.column(2).flatten().to_numpy(zero_copy_only=False)[hit].astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.ListArray.from_arrays(ends, place.drop_null()), pa.ListArray.from_arrays(ends, pa.array(tf))], names=["chunk_id", "places", "weights"])

    return run


def _best_of_places(names: pa.Array, places: np.ndarray, q: np.ndarray, w: np.ndarray, n_places: int, k: int):
    """A kernel from (id, places, values, norm) to the k best of each query in a task.

    The queries hold the places with weights: triples (places, q, w). A score is the sum of
    weight times value over norm; only positive scores count.
    """
    order = np.argsort(places, kind="stable")
    q, w = q[order], w[order]
    held = np.bincount(places, minlength=n_places)
    start = np.cumsum(held) - held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), k, 5e-7)  # the least positive score of six decimals is 1e-6
        for whole in batches:
            flat = whole.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(whole.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            met = np.concatenate([[0], np.cumsum(held[flat])])[ends]
            ids, norm = (whole.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            value = whole.column(2).flatten().to_numpy(zero_copy_only=False)
            for rows in in_slices(np.maximum(np.diff(met), len(names)), CELLS):
                n = rows.stop - rows.start
                at, x = flat[ends[rows.start] : ends[rows.stop]], value[ends[rows.start] : ends[rows.stop]]
                row = np.repeat(np.arange(n), np.diff(ends[rows.start : rows.stop + 1]))
                each = held[at]
                spot = np.repeat(start[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                part = w[spot] * np.repeat(x / norm[rows][row], each)
                scores = np.bincount(q[spot] * n + np.repeat(row, each), part, minlength=len(names) * n).reshape(-1, n)
                best.add(ids[rows], np.round(scores, 6))
        yield best.batch(names)

    return run


def _blocks(queries: DataFrame, rows: DataFrame) -> int:
    """How many blocks the queries need, by their number and that of ``rows``, their terms."""
    n = queries.agg(F.count_distinct("query_id")).first()[0], rows.count()
    return max(1, -(-n[0] // BLOCK_ROWS), -(-n[1] // BLOCK_TERMS))


def _block(df: DataFrame, b: int, blocks: int) -> list:
    return df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else df.collect()


def _found(queries: DataFrame, parts: list[DataFrame], id_col: str) -> DataFrame:
    """The union of (query_id, id, score) tables; none give an empty one."""
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], _scores(queries, id_col))


def _scores(queries: DataFrame, id_col: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, {id_col} bigint, score double"


def _names(queries: DataFrame, ids: list) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType))


def keyword_search(queries: DataFrame, lists: DataFrame, idf: DataFrame, norms: DataFrame, k: int, *, id_col: str = "chunk_id") -> DataFrame:
    """TF-IDF cosine top-k of (query_id, text); only positive scores; unknown terms are ignored.

    ``lists``, ``idf`` and ``norms`` are those of :mod:`tessella.sources.index`. Of a document, only
    the terms that the queries have meet its norm, and only k rows a query and task leave a task.
    """
    small_batches(queries.sparkSession)
    q = term_counts(queries, "query_id", F.col("text")).join(idf.select("term", "idf"), "term").select("query_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # the idf of the document's side is in the weight too
    unit = q.join(norm, "query_id").select("query_id", "term", (F.col("w") / F.col("norm") * F.col("idf")).alias("w"))
    blocks, parts = _blocks(queries, unit), []
    near = small(norms)
    for b in range(blocks):
        rows = _block(unit, b, blocks)
        if not rows:
            continue
        at = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        ids = {x: i for i, x in enumerate(dict.fromkeys(r.query_id for r in rows))}
        kernel = _best_of_places(_names(queries, list(ids)), np.array([at[r.term] for r in rows]), np.array([ids[r.query_id] for r in rows]), np.array([r.w for r in rows]), len(at), k)
        met = lists.select(F.col(id_col).cast("long"), "terms", "tfs").mapInArrow(_matched(pa.array(list(at), pa.string())), f"{id_col} bigint, places array<int>, weights array<double>")
        parts.append(met.join(near, id_col).select(id_col, "places", "weights", "norm").mapInArrow(kernel, _scores(queries, id_col)))
    return top_k(_found(queries, parts, id_col), k, tie=id_col)


def containing(queries: DataFrame, corpus: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the documents whose text contains the query's whole text.

    All tokens of a query but its first and last stand whole in such a document, so only the
    documents with the rarest of them are read for it. Queries of two tokens or fewer have none,
    and are looked for in every document. Texts are read where they are; only pairs leave a task.
    """
    small_batches(queries.sparkSession)
    tokens = T.tokens(F.col("text"))
    cut = queries.where("text is not null").select("query_id", "text", F.array_distinct(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))).alias("inner"))
    each = cut.select("query_id", "text", F.explode("inner").alias("term")).join(idf.select("term", "df"), "term", "left")
    rarest = each.groupBy("query_id", "text").agg(F.count_if(F.col("df").isNull()).alias("unknown"), F.min(F.struct("df", "term")).alias("least")).where("unknown = 0")
    wanted = rarest.select("query_id", "text", F.col("least.term").alias("term")).unionByName(cut.where(F.size("inner") == 0).select("query_id", "text", F.lit(None).cast("string").alias("term")))
    blocks, parts = _blocks(queries, wanted), []
    for b in range(blocks):
        rows = _block(wanted, b, blocks)
        if rows:
            by_term: dict[str | None, list[tuple[int, str]]] = {}
            for i, r in enumerate(rows):
                by_term.setdefault(r.term, []).append((i, r.text))
            kernel = _containing(_names(queries, [r.query_id for r in rows]), by_term)
            parts.append(corpus.where("text is not null").select("chunk_id", "text").mapInArrow(kernel, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}"))
    return reduce(DataFrame.unionByName, parts) if parts else queries.select("query_id").limit(0).crossJoin(corpus.select("chunk_id").limit(0))


def _containing(names: pa.Array, by_term: dict[str | None, list[tuple[int, str]]]):
    """A kernel from (chunk_id, text) to the (query_id, chunk_id) of the queries that a text contains; each is looked for where its term is, or everywhere."""
    always = by_term.get(None, [])
    terms = frozenset(t for t in by_term if t is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(T.TOKEN).findall
        for batch in batches:
            found = []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                met = [always, *(by_term[t] for t in terms.intersection(find(text)))] if terms else [always]
                found += ((i, row) for some in met for i, own in some if own in text)
            i, row = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column(0).take(pa.array(row))], names=["query_id", "chunk_id"])

    return run


def cells_of_counts(counts: DataFrame, key: str, dims: int = DIMENSIONS) -> DataFrame:
    """Signed hash embedding of (key, term, tf) in sparse form (key, bucket, value), unit length; zero cells are left out.

    The bucket and sign of a token are the last three hexadecimal digits of its md5.
    """
    h = F.md5(F.col("term"))
    bucket = F.pmod(F.conv(F.substring(h, 31, 2), 16, 10).cast("int"), F.lit(dims))
    sign = 1 - 2 * F.pmod(F.conv(F.substring(h, 30, 1), 16, 10).cast("int"), F.lit(2))
    raw = counts.select(key, bucket.alias("bucket"), (sign * F.col("tf")).alias("part")).groupBy(key, "bucket").agg(F.sum("part").alias("v")).where("v <> 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def hash_cells(df: DataFrame, key: str, text: Column, dims: int = DIMENSIONS) -> DataFrame:
    """:func:`cells_of_counts` of a table of texts."""
    return cells_of_counts(term_counts(df, key, text), key, dims)


def _dense(cells: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, vector) of (key, bucket, value): cells meet by key, and a kernel puts a batch of them in place at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.flatten()
            out = np.zeros((batch.num_rows, dims))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            out[row, at.field(0).to_numpy(zero_copy_only=False)] = at.field(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float64()))], names=[key, "vector"])

    own = cells.groupBy(key).agg(F.collect_list(F.struct("bucket", "value")).alias("cells"))
    return own.mapInArrow(run, f"{key} {cells.schema[key].dataType.simpleString()}, vector array<double>")


def vectors_of_lists(lists: DataFrame, key: str, dims: int = DIMENSIONS) -> DataFrame:
    """(key, vector): the hash embedding of :func:`term_lists` as an array of ``dims`` numbers; texts without a cell have no row."""
    small_batches(lists.sparkSession)

    class Codes(dict):
        """Bucket and sign of a term in one number, remembered for the terms that came last."""

        def __missing__(self, term: str) -> int:
            h = hashlib.md5(term.encode()).hexdigest()
            if len(self) >= 200_000:
                self.clear()
            self[term] = code = 2 * (int(h[30:], 16) % dims) + int(h[29], 16) % 2
            return code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for whole in batches:
            terms = whole.column(1).flatten().dictionary_encode()
            own = np.fromiter(map(codes.__getitem__, terms.dictionary.to_pylist()), np.int64, len(terms.dictionary))
            code, ends = own[terms.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum(whole.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            part = (1 - 2 * (code & 1)) * whole.column(2).flatten().to_numpy(zero_copy_only=False)
            for begin in range(0, whole.num_rows, 1000):
                end = min(begin + 1000, whole.num_rows)
                some, n = slice(ends[begin], ends[end]), end - begin
                x = np.bincount(np.repeat(np.arange(n), np.diff(ends[begin : end + 1])) * dims + (code[some] >> 1), part[some], minlength=n * dims).reshape(n, dims)
                norm = np.sqrt((x * x).sum(axis=1))
                full = np.flatnonzero(norm)
                flat = pa.array((x[full] / norm[full, None]).ravel())
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(begin + full)), pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(pa.float64()))], names=[key, "vector"])

    return lists.mapInArrow(run, f"{key} {lists.schema[key].dataType.simpleString()}, vector array<double>")


def hash_vectors(df: DataFrame, key: str, text: Column, dims: int = DIMENSIONS) -> DataFrame:
    """:func:`vectors_of_counts` of a table of texts."""
    return _dense(hash_cells(df, key, text, dims), key, dims)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def _best_of_vectors(names: pa.Array, q: np.ndarray, k: int):
    """A kernel that scores batches of (chunk_id, vector) against unit query rows and keeps the k best of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, dims = _Best(len(q), k), q.shape[1]
        step = max(1, min(1000, CELLS // len(q)))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                lists = batch.column(1)
                right = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
                if len(right):
                    x = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    best.add(batch.column(0).to_numpy(zero_copy_only=False)[right], np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T, 6))
        yield best.batch(names)

    return run


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) over (chunk_id, vector).

    The query set is taken in blocks of ``block_rows``, which is all that a task holds beside
    a batch of the corpus and the best so far. Each task gives k rows a query, so what is shuffled is small.
    Vectors of another length, and query vectors without length, find nothing.
    """
    small_batches(queries.sparkSession)
    unit = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(norm(F.col("vector")) > 0)
    blocks = max(1, -(-unit.count() // block_rows))
    rows = corpus.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>"))
    parts = []
    for b in range(blocks):
        by_size: dict[int, list] = {}
        for r in _block(unit, b, blocks):
            by_size.setdefault(len(r.vector), []).append(r)
        for some in by_size.values():
            q = np.array([r.vector for r in some])
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            parts.append(rows.mapInArrow(_best_of_vectors(_names(queries, [r.query_id for r in some]), q, k), _scores(queries, "chunk_id")))
    return top_k(_found(queries, parts, "chunk_id"), k)


def rrf(ranked: DataFrame, k: int = 60, *, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of (query_id, retriever, id, rank)."""
    fused = ranked.groupBy("query_id", id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)).cast("long"))


def weighted(ranked: DataFrame, weights: dict[str, float], *, id_col: str = "chunk_id") -> DataFrame:
    """Weighted sum of scores that are scaled to 0..1 within each list; equal scores are 1."""
    w = Window.partitionBy("query_id", "retriever")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    factor = F.coalesce(F.create_map(*(x for name, v in weights.items() for x in (F.lit(name), F.lit(v))))[F.col("retriever")], F.lit(1.0)) if weights else F.lit(1.0)
    fused = ranked.select("query_id", id_col, (scaled * factor).alias("s")).groupBy("query_id", id_col).agg(F.round(F.sum("s"), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)).cast("long"))


def fuse(ranked: DataFrame, method: str = "rrf", weights: dict[str, float] | None = None, *, id_col: str = "chunk_id") -> DataFrame:
    """Fusion of each query's lists; a query with one list keeps that list's scores."""
    lists = ranked.groupBy("query_id").agg(F.count_distinct("retriever").alias("n"))
    one = ranked.join(lists.where("n = 1"), "query_id").select("query_id", id_col, "score", "rank")
    more = ranked.join(lists.where("n > 1"), "query_id").drop("n")
    mixed = rrf(more, id_col=id_col) if method == "rrf" else weighted(more, weights or {}, id_col=id_col)
    return one.unionByName(mixed.select("query_id", id_col, "score", "rank"))


def rerank(queries: DataFrame, candidates: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "chunk_id") -> DataFrame:
    """Best candidates by the cosine of the hash embeddings of query and rerank text; ``candidates`` is a stored table."""
    wanted = corpus.join(small(candidates).select(id_col), id_col, "left_semi")
    q = hash_cells(queries, "query_id", F.col("text"))
    c = hash_cells(wanted, id_col, F.col("rerank_text"))
    pairs = candidates.select("query_id", id_col).join(q.select("query_id", "bucket", "value"), "query_id", "left").join(c.select(id_col, "bucket", F.col("value").alias("other")), [id_col, "bucket"], "left")
    scored = pairs.groupBy("query_id", id_col).agg(F.round(F.coalesce(F.sum(F.col("value") * F.col("other")), F.lit(0.0)), 6).alias("score"))
    return top_k(scored, k, tie=id_col)


def assemble_context(ranked: DataFrame, budget: int) -> DataFrame:
    """(query_id, context, n_included): numbered pieces up to a budget; the piece that crosses it is cut.

    Wants query_id, rank, title and text, and a bounded number of rows a query.
    """
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"), F.lit("\n"))
    w = Window.partitionBy("query_id").orderBy("rank")
    before = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("piece", piece).withColumn("before", before).where(F.col("before") < budget)
    cut = F.when(F.col("before") + F.length("piece") <= budget, F.col("piece")).otherwise(F.concat(F.left("piece", (budget - F.col("before")).cast("int")), F.lit("...\n")))
    gathered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cut.alias("c")))).alias("cs"))
    return gathered.select("query_id", F.array_join(F.transform("cs", lambda s: s["c"]), "\n").alias("context"), F.size("cs").cast("long").alias("n_included"))


def extractive_answer(ranked: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, answer): one numbered line a context. Wants query_id, rank, title, text, bounded rows a query."""
    flat = F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))
    snippet = F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("："), snippet)
    g = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"), F.count("*").alias("n"))
    # The answer's first and last line.
    head = F.concat(F.lit("根据知识库检索结果，为您找到以下 "), F.col("n").cast("string"), F.lit(" 条相关信息："))
    foot = F.lit("（以上内容直接摘录自知识库，未经 LLM 润色；如需更完整的智能问答，请部署生成模型服务）")
    return g.select("query_id", F.concat_ws("\n", head, F.array_join(F.transform("ls", lambda s: s["l"]), "\n"), foot).alias("answer"))


def citations(ranked: DataFrame) -> DataFrame:
    """(query_id, index, page_url, block_path, title, score) of ranked contexts."""
    return ranked.select("query_id", F.col("rank").alias("index"), "page_url", "block_path", "title", F.round("score", 4).alias("score"))


def cited_contexts(ranked: DataFrame, budget: int | None) -> DataFrame:
    """The contexts that :func:`assemble_context` lets in, whole or cut; all of them without a budget."""
    if budget is None:
        return ranked
    # "[rank] title", a line feed, the text, a line feed
    own = F.length(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"))) + F.length("text") + 2
    before = F.sum(own).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < budget).drop("_before")


def _places(at: dict[str, int], fields: int):
    """A kernel from (id, text of each field) to (id, places): the places of the distinct terms of the queries, a run of ``fields`` places a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(T.TOKEN).findall
        known = at.keys()
        for batch in batches:
            found = [[at[t] * fields + f for f in range(fields) for t in known & set(find(batch.column(f + 1)[row].as_py()))] for row in range(batch.num_rows)]
            full = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full, pa.int64())), pa.array([found[i] for i in full], pa.list_(pa.int64()))], names=["chunk_id", "places"])

    return run


def boosted_search(queries: DataFrame, corpus: DataFrame, boosts: dict[str, int], k: int, *, id_col: str = "chunk_id") -> DataFrame:
    """Top-k by the distinct terms of a query that a document has: for each field its boost.

    Rows of one id are one document. Documents are scored where they are; only those whose ids
    repeat are gathered first.
    """
    small_batches(queries.sparkSession)
    terms = term_counts(queries, "query_id", F.col("text")).select("query_id", "term")
    none = F.lit((1 << 63) - 1)  # stands for no id, last among equals
    texts = corpus.select(F.coalesce(F.col(id_col).cast("long"), none).alias(id_col), *(T.filled(F.col(f)).alias(f) for f in boosts))
    again = repeated(texts, id_col)
    several = not again.isEmpty()
    n, weights = len(boosts), np.array(list(boosts.values()), dtype=np.float64)
    blocks, parts = _blocks(queries, terms), []
    for b in range(blocks):
        rows = _block(terms, b, blocks)
        if not rows:
            continue
        at = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        ids = {x: i for i, x in enumerate(dict.fromkeys(r.query_id for r in rows))}
        places = (np.array([at[r.term] for r in rows])[:, None] * n + np.arange(n)).ravel()
        kernel = _best_of_places(_names(queries, list(ids)), places, np.repeat([ids[r.query_id] for r in rows], n), np.tile(weights, len(rows)), len(at) * n, k)
        met = texts.mapInArrow(_places(at, n), f"{id_col} bigint, places array<bigint>")
        if several:
            same = F.col(id_col) == F.col("_again")
            own = met.join(again, same, "left_semi").groupBy(id_col).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
            met = met.join(again, same, "left_anti").unionByName(own)
        met = met.select(id_col, "places", F.transform("places", lambda x: F.lit(1.0)).alias("weights"), F.lit(1.0).alias("norm"))
        parts.append(met.mapInArrow(kernel, _scores(queries, id_col)))
    return top_k(_found(queries, parts, id_col).withColumn("score", F.col("score").cast("long")), k, tie=id_col).withColumn(id_col, F.nullif(F.col(id_col), none))


def chunks_of(sample: DataFrame, corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of ``corpus`` for each sampled id; ids without a block, or with an empty one, are left out."""
    return sample.join(corpus, key).where(F.col(text) != "")


def joined_lists(lists: DataFrame, order: list[str], *, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): ranked lists one behind the other, the first copy of each id, for when fusion fails.

    ``lists`` has retriever, query_id, rank, score and the id; ``order`` names the retrievers in
    turn, and others are left out. The first results of this order are also what remains when reranking fails.
    """
    turn = F.array_position(F.array(*map(F.lit, order)), F.col("retriever"))
    first = lists.where(turn > 0).groupBy("query_id", id_col).agg(F.min_by("score", F.struct(turn, "rank")).alias("score"), F.min(F.struct(turn.alias("turn"), "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", id_col))
    return first.select("query_id", id_col, "score", place.alias("rank"))
