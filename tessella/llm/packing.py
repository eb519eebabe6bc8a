"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are encoded and cut: whole windows of a long document stand alone, and what is
left is cut into pieces of at most ``max_piece`` ids. The pieces of a run of documents
(about ``group_windows`` windows' worth) are divided over ``k = ceil(ids / window)``
windows: every piece starts as a partial partition that holds it in one of ``k`` slots,
and the two partial partitions with the largest imbalance are merged again and again,
the fullest slot of one onto the emptiest of the other. Where a window comes out above
capacity, ``k`` rises by one and the run is divided anew.

Each task packs what it reads, in one pass and without a shuffle; it holds one run at a
time. Results depend only on the input split, so a repeated task gives the same rows.

Defined results: a null text is the empty text, one end id long; null or repeated doc_ids
keep a row for each document; a text of any length is cut; no rows give no rows; columns
other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import small_batches

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divide items over ``k`` bins of near-equal total; returns the items of each bin.

    A merge keeps the order of its slots alone; bins are read off the tree of merges at the end.
    """
    n = len(sizes)
    if k == 1 or not n:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    totals: list[np.ndarray | None] = []
    for size in sizes:
        alone = np.zeros(k, dtype=np.int64)
        alone[-1] = size
        totals.append(alone)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = totals[a] + totals[b][::-1]  # each ascends: the fullest slot of one meets the emptiest of the other
        order = np.argsort(both, kind="stable")
        both = both[order]
        totals[a] = totals[b] = None
        totals.append(both)
        heapq.heapreplace(heap, (int(both[0]) - int(both[-1]), n + len(merges)))
        merges.append((a, b, order))
    # bins[x] is the bin of each slot of partition x; a merge passes it to its two parts
    bins: list[np.ndarray | None] = [None] * (n + len(merges))
    bins[-1] = np.arange(k)
    for x in range(len(merges) - 1, -1, -1):
        a, b, order = merges[x]
        own = np.empty(k, dtype=np.int64)
        own[order] = bins[n + x]
        bins[a], bins[b], bins[n + x] = own, own[::-1], None
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        out[int(bins[i][-1])].append(i)
    return out


def pack(sizes: list[int], window: int) -> list[list[int]]:
    """Bins of at most ``window``; one more bin whenever capacity is exceeded. Empty bins are left out."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        bins = differencing(sizes, k)
        if all(sum(sizes[i] for i in b) <= window for b in bins):
            return [b for b in bins if b]
        k += 1


def cut(n: int, window: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then pieces of ``max_piece``, then what is left.

    The last pieces differ in size from document to document, which is what lets windows even out.
    """
    out = [(s, window) for s in range(0, n - window + 1, window)]
    for start in range(n - n % window, n, max_piece):
        out.append((start, min(max_piece, n - start)))
    return out


def _packer(tokenizer: str, end_id: int, window: int, max_piece: int, group_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        end = np.array([end_id], coder.dtype)
        sequence = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        items: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal sequence, items, held
            for members in pack([i[2] for i in items], window):
                offset = 0
                for m in members:
                    done.append((*items[m], sequence, offset))
                    offset += items[m][2]
                sequence += 1
            items, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal done
            rows, done = done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_NAMES)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), coder.encode_column(batch.column(1))):
                ids = np.concatenate([coded, end]).astype("<u4")
                n = len(ids)
                for start, length in cut(n, window, max_piece):
                    crc = zlib.crc32(ids[start : start + length])
                    if length == window:
                        done.append((doc_id, start, length, crc, n, sequence, 0))
                        sequence += 1
                    else:
                        items.append((doc_id, start, length, crc, n))
                        held += length
                if held >= group_windows * window:
                    close()
                if len(done) >= 20_000:
                    yield flush()
        close()
        if done:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = 1024, max_piece: int = 256, group_windows: int = 128) -> DataFrame:
    """One row a piece: the ids it holds, and the sequence and offset they go to."""
    if not 0 < max_piece <= window:
        raise ValueError("max_piece must be between 1 and window")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, end_id, window, max_piece, group_windows), PIECE_SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all of ``documents`` into sequences of at most 1024 ids."""
    from tessella.session import table

    small_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_path())
