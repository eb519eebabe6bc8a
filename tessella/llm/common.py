"""Helpers shared by the operators: work tables, sampling, batching."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.work import Workspace, small_batches, work_folder

__all__ = ["MEMOS", "Workspace", "begin_task", "bounded_sample", "fresh_name", "held_out", "in_pieces", "release", "small_batches", "texts_of", "work_folder"]


#: What drops the memo of a module in this Python worker, by module.
MEMOS: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def begin_task(module: str) -> None:
    """Called where a kernel begins: workers are used again, so other modules' memos and freed memory go first."""
    for name, drop in MEMOS.items():
        if name != module:
            drop()
    release()


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id's text is a multiple of 5."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, keys: list[str], most: int, *, size: Column | None = None, most_size: int = 0) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of ``keys``; the same rows at every run.

    With ``size``, they also sum up to ``most_size`` at most. Rows of one hash class come or
    stay out together, whatever their number, so repeated keys cannot break the bound.
    """
    sums = [F.count("*").alias("n"), (F.lit(0) if size is None else F.coalesce(F.sum(size), F.lit(0))).alias("size")]
    total = df.agg(*sums).first()
    if total.n <= most and (size is None or total.size <= most_size):
        return df
    share = max(total.n / most, total.size / most_size if size is not None else 0)
    classes, taken = int(share * 64), 256
    number = F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(classes))
    rows = size_so_far = 0
    chosen = []
    for r in sorted(df.where(number < taken).groupBy(number.alias("class")).agg(*sums).collect(), key=lambda r: r["class"]):
        if rows + r.n <= most and (size is None or size_so_far + r.size <= most_size):
            rows, size_so_far = rows + r.n, size_so_far + r.size
            chosen.append(r["class"])
    return df.where(number.isin(chosen))


def in_pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[list[int]]:
    """Split a batch into runs of row numbers of about ``chars`` characters, so that scratch arrays stay small."""
    run: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        run.append(i)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def texts_of(column) -> list[str]:
    """An Arrow string column as a list, null read as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def fresh_name(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until it clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
