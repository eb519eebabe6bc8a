"""Plain-text chunking: recursive split, greedy packing, overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", ". ", "! ", "? ", ", ", " "]


def atoms(text: str, most: int, level: int = 0) -> Iterator[str]:
    """Pieces of at most ``most`` characters, each cut at the coarsest separator that does, separators kept at the end."""
    if len(text) <= most:
        if text:
            yield text
        return
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        yield from (text[i : i + most] for i in range(0, len(text), most))
        return
    sep = SEPARATORS[level]
    *heads, tail = text.split(sep)
    for part in [*(h + sep for h in heads), tail]:
        yield from atoms(part, most, level + 1)


def chunk(text: str | None, most: int = 500, overlap: int = 50, lossless: bool = False) -> list[str]:
    """Chunks of a text.

    Each begins with the last ``overlap`` characters of the chunk before it. Where that
    makes it too long, its own end is cut off; ``lossless`` packs smaller chunks instead.
    """
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("need most > 0 and 0 <= overlap < most")
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    room = most - overlap if lossless else most
    packed: list[str] = []
    for a in atoms(text, room):
        if packed and len(packed[-1]) + len(a) <= room:
            packed[-1] += a
        else:
            packed.append(a)
    out = packed[:1]
    for before, own in zip(packed, packed[1:]):
        lead = before[-overlap:] if overlap else ""
        out.append(lead + own[: most - len(lead)])
    return [c for c in map(str.strip, out) if c]


def chunk_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 500, overlap: int = 50, lossless: bool = False) -> DataFrame:
    """(id, chunk_idx, text) of every chunk of every document."""
    chunk("", most, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(chunk(text, most, overlap, lossless)):
                    keys.append(key)
                    numbers.append(i)
                    texts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "chunk_idx", "text"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, chunk_idx int, text string")


def pack_words(words: Column, most: int) -> Column:
    """Greedy packing of an array of strings into an array of joined strings, all in the engine."""
    start = F.array().cast("array<string>")

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + F.length(w) <= most)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, w)))).otherwise(F.array_append(done, w))

    return F.aggregate(words, start, step)
