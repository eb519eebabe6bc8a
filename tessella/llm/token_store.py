"""Token-id store: concatenated id arrays with Elias-Fano coded document boundaries.

A store is a Parquet folder of *segments* in ascending document order. Each segment is
one self-contained byte string: the ids of its documents end to end, and two Elias-Fano
sequences, the ends of the documents and their doc_ids. Elias-Fano keeps ``n`` ascending
values below ``u`` in about ``n * (2 + log2(u / n))`` bits; a table of every 256th set
bit answers ``select`` without 64-bit offsets. Parquet is only the container: it brings
Spark's commit protocol, so a lost executor or a second attempt leaves no torn segment,
and any store that Spark can write.

Defined results: a null text is the empty text and yields the end id alone; null doc_ids
sort first and come back null; equal doc_ids are ordered by text and keep a row each; a
table without rows gives a store without segments; columns other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import Workspace, small_batches

MAGIC = b"TESSEF01"
#: magic, bytes an id, null doc_ids, documents, ids, smallest doc_id
_HEAD = struct.Struct("<8sBQQQq")
#: values, low bits of each, bytes of the low part, bytes of the high part, select samples
_EF_HEAD = struct.Struct("<QBQQQ")
_EVERY = 256

SEGMENT_SCHEMA = "shard int, segment int, shard_start long, n_docs long, n_tokens long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, segment_offset long"


class EliasFano:
    """Ascending unsigned 64-bit values with ``select``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("Elias-Fano needs ascending values")
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n and top else 0
        low = b""
        if low_bits and n:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::_EVERY].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = _EF_HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples = _EF_HEAD.unpack_from(data, at)
        at += _EF_HEAD.size
        low, at = bytes(data[at : at + n_low]), at + n_low
        high, at = bytes(data[at : at + n_high]), at + n_high
        samples = np.frombuffer(data, "<u8", n_samples, at)
        return cls(n, low_bits, low, high, samples), at + 8 * n_samples

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        begin = first * self.low_bits
        skip = begin % 8
        raw = np.frombuffer(self.low, np.uint8)[begin // 8 : (begin + count * self.low_bits + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[skip : skip + count * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(count, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value ``i``, read from one block between two samples."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = i // _EVERY
        begin = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        skip = begin % 8
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[begin // 8 : (end + 7) // 8], bitorder="little")[skip:]
        place = begin + int(np.flatnonzero(bits)[i - block * _EVERY])
        return (place - i) << self.low_bits | int(self._lows(i, 1)[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        highs = (ones - np.arange(self.n)).astype(np.uint64)
        return highs << np.uint64(self.low_bits) | self._lows(0, self.n)


class Segment:
    """A decoded segment: random access to documents by position."""

    def __init__(self, payload: bytes):
        data = memoryview(payload)
        magic, self.width, self.n_null, self.n_docs, self.n_tokens, self.base = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of a token store")
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size)
        self.keys, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens, at)

    @staticmethod
    def pack(doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
        known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
        base = int(known[0]) if len(known) else 0
        keys = known.astype(np.uint64) - np.int64(base).astype(np.uint64)
        ends = np.cumsum([len(p) // width for p in parts], dtype=np.int64)
        head = _HEAD.pack(MAGIC, width, len(doc_ids) - len(known), len(parts), int(ends[-1]) if len(ends) else 0, base)
        return b"".join([head, EliasFano.build(ends).to_bytes(), EliasFano.build(keys).to_bytes(), *parts])

    def bounds(self, i: int) -> tuple[int, int]:
        """First and end place of document ``i`` in the segment's ids, by ``select``."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.ids[begin:end]

    def doc_ids(self) -> list[int | None]:
        known = (self.keys.values() + np.int64(self.base).astype(np.uint64)).astype(np.int64)
        return [None] * self.n_null + known.tolist()


def _encoder(tokenizer: str, end_id: int, segment_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        end = end_id.to_bytes(coder.width, "little")
        shard = TaskContext.get().partitionId()
        number, written, held, ids, parts = 0, 0, 0, [], []
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

        def close() -> pa.RecordBatch:
            row = [[shard], [number], [written], [len(parts)], [held], [Segment.pack(ids, parts, coder.width)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), coder.encode_column(batch.column(1))):
                ids.append(doc_id)
                parts.append(coded.tobytes() + end)
                held += len(parts[-1]) // coder.width
                if held >= segment_tokens:
                    yield close()
                    number, written, held, ids, parts = number + 1, written + held, 0, [], []
        if parts:
            yield close()

    return encode


def write_store(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_tokens: int = 1 << 20) -> None:
    """Encode ``docs`` and write a store at ``path`` in ascending ``id_col``.

    One shuffle ranges the texts by id; a shard is a range, a segment about
    ``segment_tokens`` ids of it. A document is never cut between segments.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encoder(tokenizer, end_id, segment_tokens), SEGMENT_SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store with ``base``, the number of ids before each shard.

    Only one number a shard passes through the driver.
    """
    seg = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    base, bases = 0, []
    for shard, n in seg.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").collect():
        bases.append((shard, base))
        base += n
    return seg.join(F.broadcast(spark.createDataFrame(bases, "shard int, base long")), "shard")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            seg = Segment(row["payload"])
            ends = seg.ends.values().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            wide = seg.ids.astype("<u4")
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            before = row["base"] + row["shard_start"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg.doc_ids(), pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array(starts)],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "segment_offset"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the store alone: its place, its length and the crc32 of its ids."""
    return segments(spark, path).select("base", "shard_start", "payload").mapInArrow(_reader, DOC_SCHEMA)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``documents`` as a token store and read it back."""
    from tessella.session import table

    small_batches(spark)
    path = f"{Workspace(spark).folder}/tokens"
    write_store(table(spark, sf_dir, "documents"), path, bpe.tokenizer_path())
    return read_documents(spark, path)
