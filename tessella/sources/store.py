"""A corpus kept as Parquet snapshots: blocks, registry and versions.

Documents are dealt into buckets by the hash of their id. A change writes new files for the
buckets that it touches, beside the old ones, and then names the files of every bucket in a
manifest; readers follow the newest manifest, so a change that fails leaves the corpus as it
was, and one document costs a bucket, not the corpus.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import knowledge as K
from tessella.operators import retrieval as R
from tessella.operators.chunking import chunk_documents
from tessella.sources.files import documents
from tessella.sources.index import build
from tessella.sources.sessions import Sessions
from tessella.work import work_folder

#: Most blocks of one ingest, most versions kept of a document.
MOST_BLOCKS, MOST_VERSIONS = 5000, 50
BLOCKS = "global_chunk_idx long, doc_id string, source string, chunk_idx int, page_name string, title string, page_url string, text string, summary string, block_path string, time string"
VERSIONS = "doc_id string, hash string, num_chunks long, filename string, created_at timestamp"
_SCHEMAS = {"blocks": BLOCKS, "versions": VERSIONS}


BUCKETS = 64
_MANIFEST = "number long, top long, blocks map<string,string>, versions map<string,string>"


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


def digest(blocks: DataFrame) -> DataFrame:
    """(doc_id, hash, num_chunks): the hash of each document's texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda s: s["text"])
    return blocks.groupBy("doc_id").agg(F.substring(F.sha2(F.array_join(texts, "\n"), 256), 1, 16).alias("hash"), F.count("*").alias("num_chunks"))


class Corpus:
    """Blocks by id, and the versions of their documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        newest = None
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            newest = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest").orderBy(F.desc("number")).first()
        if newest is None:
            return {"number": 0, "top": -1} | {name: {} for name in _SCHEMAS}
        return newest.asDict() | {name: {int(b): p for b, p in (newest[name] or {}).items()} for name in _SCHEMAS}

    def _commit(self, top: int | None, touched: list[int], **tables: DataFrame) -> None:
        """Put ``tables`` in place of what the ``touched`` buckets held."""
        entry = self._manifest()
        entry["number"] += 1
        entry["top"] = entry["top"] if top is None else top
        for name, df in tables.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.withColumn("bucket", _bucket(F.col("doc_id"))).write.partitionBy("bucket").parquet(path)
            held = {r.bucket for r in self.spark.read.parquet(path).select("bucket").distinct().collect()} if self._has_files(path) else set()
            entry[name] = {b: p for b, p in entry[name].items() if b not in touched} | {b: f"{path}/bucket={b}" for b in touched if b in held}
        entry |= {name: {str(b): p for b, p in entry[name].items()} for name in _SCHEMAS}
        self.spark.createDataFrame([entry], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _has_files(self, path: str) -> bool:
        """Whether a table written in buckets has any; one without rows has no bucket."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(f.getPath().getName().startswith("bucket=") for f in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where))

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self._manifest()[name].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[name])

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks")

    @property
    def versions(self) -> DataFrame:
        return self._read("versions")

    def registry(self) -> DataFrame:
        return self.blocks.groupBy("doc_id").agg(F.first("source").alias("source"), F.count("*").alias("num_chunks"), F.min("global_chunk_idx").alias("first_chunk"), F.max("global_chunk_idx").alias("last_chunk"))

    def ingest(self, blocks: DataFrame, doc_id: str, filename: str = "", at: str = "1970-01-01 00:00:00") -> int:
        """:meth:`ingest_all` for one document; returns the number of its blocks."""
        return self.ingest_all(blocks.withColumn("doc_id", F.lit(doc_id)).withColumn("filename", F.lit(filename)), at)

    def ingest_all(self, blocks: DataFrame, at: str = "1970-01-01 00:00:00") -> int:
        """Add the blocks that have a text, of documents by ``doc_id`` and ``filename``, in one commit; returns their number.

        An earlier document of an id is replaced. New ids follow the largest id ever given, by
        doc_id and then place. A document of more than ``MOST_BLOCKS`` blocks refuses them all.
        """
        kinds = dict(c.split() for c in BLOCKS.split(", "))
        have = set(blocks.columns)
        wide = blocks.select(*((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items() if c != "global_chunk_idx"), "filename")
        good = wide.where(F.trim(T.filled(F.col("text"))) != "")
        sizes = {r.doc_id: r for r in good.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("filename").alias("filename"), _bucket(F.col("doc_id")).alias("bucket")).collect()}
        if over := [f"{r.n} blocks, at most {MOST_BLOCKS}: {d}" for d, r in sizes.items() if r.n > MOST_BLOCKS]:
            raise ValueError("; ".join(over))
        ids = {r.doc_id for r in blocks.select("doc_id").distinct().collect()}
        touched = sorted({zlib.crc32((d or "").encode()) % BUCKETS for d in ids})
        top = self._manifest()["top"]
        starts, at_id = [], top
        for d in sorted(sizes, key=lambda d: (d is not None, d or "")):
            starts.append((d, at_id, sizes[d].filename))
            at_id += sizes[d].n
        first = F.broadcast(self.spark.createDataFrame(starts, "d string, base long, name string"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "text"))  # MOST_BLOCKS rows at most
        new = good.withColumn("_n", place).join(first, good["doc_id"].eqNullSafe(F.col("d"))).withColumn("global_chunk_idx", F.col("_n") + F.col("base")).select(*kinds)
        stay = lambda df: df.where(~F.coalesce(F.col("doc_id").isin([d for d in ids if d is not None]), F.lit(None in ids)))
        rows = digest(new).join(first, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "hash", "num_chunks", F.col("name").alias("filename"), F.lit(at).cast("timestamp").alias("created_at"))
        history = self._read("versions", touched).withColumn("version", F.lit(0)).unionByName(rows.withColumn("version", F.lit(1)))
        self._commit(at_id, touched, blocks=stay(self._read("blocks", touched)).unionByName(new), versions=K.last_versions(history, MOST_VERSIONS).drop("version"))
        return sum(r.n for r in sizes.values())

    def ingest_folder(self, folder: str, *, most: int = 500, overlap: int = 50, at: str = "1970-01-01 00:00:00") -> tuple[int, DataFrame]:
        """Cut every readable file of a folder into chunks and add them in one commit.

        Returns the number of blocks and the (path, error) of files that were refused. A document's
        id is the hash of its path, so that a file read again replaces what it gave before.
        """
        read = documents(self.spark, folder).withColumn("file_id", F.xxhash64("path"))
        good = read.where("error is null")
        chunks = chunk_documents(good, id_col="file_id", most=most, overlap=overlap)
        name = F.regexp_extract("path", "[^/]+$", 0)
        named = good.select("file_id", F.substring(F.sha2("path", 256), 1, 16).alias("doc_id"), name.alias("filename"), F.col("path").alias("page_url"))
        blocks = chunks.join(named, "file_id").select("doc_id", "filename", "chunk_idx", "text", "page_url", F.lit("upload").alias("source"), F.col("filename").alias("page_name"))
        return self.ingest_all(blocks, at), read.where("error is not null").select("path", "error")

    def delete(self, doc_id: str) -> bool:
        """Take a document out; True if it was there."""
        buckets = [zlib.crc32(doc_id.encode()) % BUCKETS]
        held = self._read("blocks", buckets)
        there = not held.where(F.col("doc_id") == doc_id).isEmpty()
        if there:
            self._commit(None, buckets, blocks=held.where(~F.col("doc_id").eqNullSafe(doc_id)))
        return there

    def delete_page(self, page_url: str) -> None:
        """Take out the blocks of a page, whatever their documents."""
        buckets = sorted(r.b for r in self.blocks.where(F.col("page_url") == page_url).select(_bucket(F.col("doc_id")).alias("b")).distinct().collect())
        if buckets:
            self._commit(None, buckets, blocks=self._read("blocks", buckets).where(~F.col("page_url").eqNullSafe(page_url)))

    def stats(self) -> DataFrame:
        return self.blocks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, global_chunk_idx, score, rank): the k blocks nearest to each query by TF-IDF over title, summary and text.

        ``queries`` has query_id and text; a blank one finds nothing, and only scores above 0 count.
        """
        text = T.corpus_text(F.col("title"), F.col("summary"), F.lit(None).cast("string"), F.col("text"))
        index = build(self.blocks.select(F.col("global_chunk_idx").alias("chunk_id"), text.alias("text")), work_folder(self.spark))
        return R.keyword_search(queries, index.lists, index.idf, index.norms, k).withColumnRenamed("chunk_id", "global_chunk_idx")


_OPEN: dict[tuple[str, str], object] = {}


def open_store(spark: SparkSession, kind: str, folder: str):
    """The one store of a kind (corpus or sessions) in a folder; the same object while the session lasts."""
    kinds = {"corpus": Corpus, "sessions": Sessions}
    if kind not in kinds:
        raise ValueError(f"no store of kind {kind!r}; there are {', '.join(sorted(kinds))}")
    found = _OPEN.get((kind, folder.rstrip("/")))
    if found is None or found.spark is not spark:
        found = _OPEN[kind, folder.rstrip("/")] = kinds[kind](spark, folder)
    return found
