"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import imatch, langid, line_dedup, packing, piece_viterbi, quality, secret_scan, simhash, token_store, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": token_store.op1_token_store,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_langid": langid.op4_langid,
    "op5_pieces": piece_viterbi.op5_pieces,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_imatch": imatch.op9_imatch,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL: dict[str, str] = {"op9_imatch": imatch.ORACLE}
