"""Incremental ingestion of a folder of JSON blocks into a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources.files import BLOCK_FIELDS
from tessella.sources.store import Corpus, digest


def ingest_folder(spark: SparkSession, folder: str, corpus: Corpus, *, files: int = 100):
    """A stream writer that ingests each new file once, as a document named by its path.

    A trigger takes at most ``files`` files. A file whose blocks hash like the newest version
    of its document is skipped.
    """
    stream = spark.readStream.schema(BLOCK_FIELDS).option("multiLine", "true").option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.json").json(folder)
    named = stream.withColumn("path", F.col("_metadata.file_path"))

    def merge(batch: DataFrame, _: int) -> None:
        kept = batch.where(F.trim(T.filled(F.col("text"))) != "")
        named = kept.withColumn("doc_id", F.col("path")).withColumn("filename", F.element_at(F.split("path", "/"), -1))
        latest = corpus.versions.groupBy(F.col("doc_id").alias("known")).agg(F.max_by("hash", "created_at").alias("latest"))
        hashes = digest(named.withColumn("chunk_idx", F.col("chunk_idx").cast("int")))
        wanted = hashes.join(latest, hashes["doc_id"] == latest["known"], "left").where(~F.col("hash").eqNullSafe(F.col("latest"))).select("doc_id")
        if not wanted.isEmpty():
            corpus.ingest_all(named.join(wanted, "doc_id", "left_semi"))

    return named.writeStream.foreachBatch(merge)
