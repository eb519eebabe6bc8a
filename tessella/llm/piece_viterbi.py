"""SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

The automaton holds every ordinary piece. One pass over a text follows its output links:
at each position it reports all pieces that end there, longest first, and each relaxes
the best score of that position. The best path is the segmentation with the highest sum
of piece scores; of equal sums the one with the longest last piece. For a unigram model
that is the library's own encoding; for a merge model, whose scores are ranks, it is the
best-scored segmentation instead of the merges' order.

A character that is in no piece, and the space mark where a text itself holds one, is
written as its UTF-8 bytes with the model's byte pieces, so that decoding gives back
every text. No piece has a space mark after another character (checked on loading), nor
a line feed, so a text may be cut before each of them; words are memoized.

Defined results: null encodes to null and decodes to null; the empty text encodes to no
piece; text of any length is encoded whole; repeated rows encode alike; no rows give no
rows; other columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import MEMOS, begin_task, small_batches

MARK = "▁"
_OWN = "\ud800"  # stands for a mark of the text itself; no text has this code
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_OFTEN, _ONCE, _MEMO_CHARS = 300_000, 200_000, 48


class _Memo(dict):
    """Encodings by word: those met twice in itself, those met once beside it."""

    def __init__(self, encode):
        self.encode, self.once = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.once.pop(word, None)
        if ids is not None:
            self[word] = ids
            return ids
        ids = self.encode(word)
        if len(word) <= _MEMO_CHARS:
            if len(self.once) >= _ONCE:
                self.once = dict(islice(self.once.items(), _ONCE // 2, None))
            self.once[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > _OFTEN:
            kept = list(islice(self.items(), _OFTEN // 2, None))
            self.clear()
            self.update(kept)


class Pieces:
    """Scores and ids of a SentencePiece model, and the automaton over its pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.dtype = "<u2" if n <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.scores: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.raw = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.raw[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.scores[piece] = (i, sp.get_score(i))
                self.raw[i] = piece.replace(MARK, " ").encode()
        if len(self.bytes) != 256:
            raise ValueError("the model needs byte pieces")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("a piece reaches over a word's begin")
        self.byte_score = min(s for _, s in self.scores.values()) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.scores.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.memo = _Memo(self._word)

    def segment(self, word: str) -> tuple[list[int], float]:
        """Ids and score of the best path through a word."""
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        scores, fallback, done = self.scores, self.byte_score, 0
        for end, (length, i, score) in self.automaton.iter(word):
            while done < end:  # positions passed without a one-character piece fall back to bytes
                if word[done] not in scores and best[done] + fallback > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + fallback, (1, -1)
                done += 1
            s = best[end + 1 - length] + score
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (length, i)
        while done < n:
            if word[done] not in scores and best[done] + fallback > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + fallback, (1, -1)
            done += 1
        ids: list[int] = []
        at = n
        while at:
            length, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                c = word[at - 1]
                ids.extend(self.bytes[b] for b in reversed((MARK if c == _OWN else c).encode()))
            at -= length
        return ids[::-1], best[n]

    def _word(self, word: str) -> bytes:
        """``word`` with the mark put before it, unless it begins with a line feed."""
        if word[:1] == "\n":
            ids = [self.bytes[10]] + (self.segment(word[1:])[0] if len(word) > 1 else [])
        else:
            ids = self.segment(MARK + word)[0]
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        self.memo.trim()
        if not text:
            return np.empty(0, self.dtype)
        if MARK in text:
            text = text.replace(MARK, _OWN)
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or text[0] == "\n" or " \n" in text:
            words = _WORD.findall(MARK + text.replace(" ", MARK))
            raw = b"".join(np.array(self.segment(w)[0], self.dtype).tobytes() for w in words)
        else:
            raw = b"".join(map(self.memo.__getitem__, parts))
        return np.frombuffer(raw, self.dtype)

    def decode(self, ids) -> str:
        """The text of ids; ids that are no text's encoding decode with replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


MEMOS["piece_viterbi"] = load.cache_clear


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _replaced(docs: DataFrame, column: str, kind: str, change) -> DataFrame:
    schema = docs.withColumn(column, F.lit(None).cast(kind)).schema
    to = {"array<int>": pa.list_(pa.int32()), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("piece_viterbi")
        for batch in batches:
            names = batch.schema.names
            i = names.index(column)
            new = pa.array([None if v is None else change(v) for v in batch.column(i).to_pylist()], to)
            yield pa.RecordBatch.from_arrays([new if k == i else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, schema)


def encode_column(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """``docs`` with the texts of ``column`` replaced by arrays of ids."""
    return _replaced(docs.withColumn(column, F.col(column).cast("string")), column, "array<int>", lambda t: load(model).encode(t).tolist())


def decode_column(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """``docs`` with the id arrays of ``column`` replaced by texts."""
    return _replaced(docs.withColumn(column, F.col(column).cast("array<int>")), column, "string", lambda ids: load(model).decode(ids))


def encode_digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, round_trip): sizes and digest of each encoding, and whether it decodes to the text."""
    names = ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("piece_viterbi")
        pieces = load(model)
        low, high = min(pieces.bytes.values()), max(pieces.bytes.values())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = pieces.encode(text or "")
                rows.append((doc_id, len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(ids.astype("<u4")), pieces.decode(ids.tolist()) == (text or "")))
            types = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all of ``documents``, decode them again, and compare."""
    from tessella.session import table

    small_batches(spark)
    return encode_digests(table(spark, sf_dir, "documents"), model_path())
