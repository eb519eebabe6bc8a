"""A training-text pipeline: five stages, each a table of documents to the next.

Each stage takes the whole table that the one before it wrote, in the columns of
``documents``, and the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, line_dedup, packing, secret_scan, simhash
from tessella.llm.common import Workspace, fresh_name, small_batches
from tessella.session import table
from tessella.work import setting


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is such a column, set to the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or too uncertain, go."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly so, go; so do documents of which nothing with a word stays."""
    number = fresh_name(docs.columns, "n_dropped")
    out = line_dedup.dedup_lines(docs, dropped=number)
    emptied = (F.col(number) > 0) & ~F.col("text").rlike(line_dedup._WORD)
    return _counted(out.where(F.coalesce(~emptied, F.lit(True))).drop(number))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that shares 0.8 or more of its shingles of five words, or nearly all fingerprint bits.

    Line dedup leaves near copies as remnants that share nothing, so a document's text as it
    came into the pipeline counts beside the text that is left of it.
    """
    small_batches(spark)
    # a thousand long texts at once, and the buffers that grow with them, are most of an executor's memory
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "8m"):
        return simhash.dedup_similar(docs, earlier=table(spark, sf_dir, "documents"), width=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    small_batches(spark)
    return _counted(secret_scan.redact(docs, secret_scan.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 1024."""
    small_batches(spark)
    return packing.pack_documents(docs, bpe.tokenizer_path())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Trained models and hashed shingles are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
