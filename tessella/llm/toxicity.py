"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the summed weights of its words, each hashed
whole and by its first 4, 5 and 6 bytes, since endings vary; a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only
document labels train the weights, by gradient ascent on the likelihood of the noisy-or
with a penalty on large weights; the sentence scores then tell which sentences offend.
Training uses at most ``sample_docs`` labelled rows with ``sample_chars`` characters
together, chosen by hash.

Defined results: a null or wordless text has no sentence and so the score 0; text of any
length counts whole; a document labelled more than once takes its largest label; labels
that are null or name no document teach nothing; without labels the score is that of an
untrained sentence; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_sample, held_out, in_pieces, release, small_batches, texts_of
from tessella.llm.features import hash_words, sigmoid

BITS = 18
PREFIXES = (4, 5, 6)
START = -6.0
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_STOP = b"."
_STRIP = bytes.maketrans(b',;:"()[]{}*|', b" " * 12)


_EMPTY = (np.empty((0, 1 + len(PREFIXES)), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


def _tokens(text: str) -> list[bytes]:
    """Lower-case words, with a lone stop after each sentence."""
    raw = text.lower().encode("utf-8", "replace").translate(_STRIP)
    for mark in (b".", b"!", b"?", b"\n"):
        raw = raw.replace(mark, b" . ")
    return raw.split()


def _hashes(words: list[bytes]) -> np.ndarray:
    """One row a word: hashes of the word and of its beginnings."""
    return np.stack([hash_words(words, BITS), *(hash_words([b"%d" % n + w[:n] for w in words], BITS) for n in PREFIXES)], axis=1)


def _sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the sentence of each word, and the row of each sentence that has a word."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        w = _tokens(t)
        sizes.append(len(w) + 1)
        words += w
        words.append(_STOP)
    if not words:
        return _EMPTY
    h = _hashes(words)
    stop = np.fromiter(map(_STOP.__eq__, words), bool, len(words))
    row = np.repeat(np.arange(len(texts)), sizes)
    number = np.cumsum(stop)[~stop]
    if not len(number):
        return _EMPTY
    first = np.concatenate([[True], number[1:] != number[:-1]])
    return h[~stop], np.cumsum(first) - 1, row[~stop][first]


def _bag(text: str) -> np.ndarray:
    """Hashes of a text's words, with -1 in place of each stop."""
    words = _tokens(text)
    if not words:
        return _EMPTY[0]
    h = _hashes(words)
    h[np.fromiter(map(_STOP.__eq__, words), bool, len(words))] = -1
    return h


class Scorer:
    """Word weights and the offset of a sentence."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset

    def _sentence_margins(self, h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        return np.bincount(sentence, self.weights[h].sum(axis=1)) + self.offset

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Noisy-or of each text, its offending sentences (p >= 0.5), and its highest sentence score."""
        out, count, most = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for rows in in_pieces(texts, 1_000_000):
            h, sentence, row = _sentences([texts[i] for i in rows])
            if not len(h):
                continue
            m = self._sentence_margins(h, sentence)
            at = np.array(rows)
            clean = np.bincount(row, -np.logaddexp(0, m), minlength=len(rows))  # log(1 - p)
            out[at] = -np.expm1(clean)
            count[at] = np.bincount(row, m >= 0, minlength=len(rows)).astype(np.int64)
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, row, m)
            most[at] = sigmoid(top)
        return np.clip(out, 0, 1), count, most

    def locate(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence of a text that has a word, offsets in code points."""
        out = []
        for m in _SENTENCE.finditer(text):
            h, sentence, _ = _sentences([m.group()])
            if len(h):
                out.append((m.start(), m.end(), float(sigmoid(self._sentence_margins(h, sentence))[0])))
        return out


def train(bags: list[np.ndarray], labels: np.ndarray, *, steps: int = 200, rate: float = 100.0, decay: float = 1e-5, least_docs: int = 6, least_z: float = 4.0) -> Scorer:
    """Fit to bags of word hashes, a row a word, in which -1 ends a sentence.

    Only hashes in ``least_docs`` bags or more, whose share of toxic bags stands ``least_z``
    standard deviations above the overall share, get a weight. Steps are plain momentum, so
    that a word's weight grows with the bags that speak for it, and rare words cannot
    explain a document first.
    """
    weights, offset = np.zeros(1 << BITS), np.array([START])
    if len(set(labels.tolist())) < 2:
        return Scorer(weights, START)
    docs_with, toxic_with = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for bag, label in zip(bags, labels.tolist()):
        own = np.unique(bag[bag >= 0])
        docs_with[own] += 1
        toxic_with[own] += label > 0
    share = (labels > 0).mean()
    z = (toxic_with - docs_with * share) / np.sqrt(np.maximum(docs_with, 1) * share * (1 - share))
    telling = (docs_with >= least_docs) & (z >= least_z)
    used = np.flatnonzero(telling)
    slots = np.zeros(1 << BITS, np.int32)
    slots[used] = np.arange(len(used))
    place, slot, times, row, sentences = [], [], [], [], 0
    for i, bag in enumerate(bags):
        keep = bag[:, 0] >= 0
        if not keep.any():
            continue
        n, own = np.cumsum(~keep)[keep], bag[keep]
        first = np.concatenate([[True], n[1:] != n[:-1]])
        number = sentences + np.cumsum(first) - 1
        row.append(np.full(int(first.sum()), i))
        sentences += int(first.sum())
        word, which = np.nonzero(telling[own])
        # one entry for each sentence and hash, with its count
        entry, count = np.unique(number[word] * len(used) + slots[own[word, which]], return_counts=True)
        place.append(entry // max(1, len(used)))
        slot.append(entry % max(1, len(used)))
        times.append(count)
    if not row:
        return Scorer(weights, START)
    place, slot, times, row = map(np.concatenate, (place, slot, times, row))
    w = np.zeros(len(used))
    speed, speed_offset = np.zeros(len(used)), 0.0
    for _ in range(steps):
        m = np.bincount(place, w[slot] * times, sentences) + offset[0]
        clean = np.bincount(row, -np.logaddexp(0, m), minlength=len(bags))
        p = np.clip(-np.expm1(clean), 1e-9, 1)
        # d log L / d m is p_s (1 - P) / P for a sentence of a toxic document, and -p_s of a clean one
        gain = np.where(labels > 0, (1 - p) / p, -1.0)
        g = sigmoid(m) * gain[row] / len(bags)
        speed = 0.9 * speed + rate * 0.1 * (np.bincount(slot, g[place] * times, len(used)) - decay * w)
        speed_offset = 0.9 * speed_offset + 0.1 * float(g.sum())
        w += speed
        offset += speed_offset
    weights[used] = w
    return Scorer(weights, float(offset[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 6000, sample_chars: int = 60_000_000) -> Scorer:
    """Learn from at most ``sample_docs`` labelled rows, of ``sample_chars`` characters together, that :func:`held_out` does not mark."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().where(~held_out("doc_id"))
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), ["doc_id"], sample_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_bag(text).astype("<i4").tobytes() for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    rows = bounded_sample(rows.select("doc_id", "text", "label"), ["doc_id", "text"], sample_docs, size=F.length("text"), most_size=sample_chars)
    got = rows.mapInArrow(run, "doc_id long, label int, bag binary").toArrow()
    bags = [np.frombuffer(b.as_buffer(), "<i4").reshape(-1, 1 + len(PREFIXES)) for b in got.column("bag")]
    ids, labels = got.column("doc_id").to_pylist(), got.column("label").to_numpy()
    order = sorted(range(len(bags)), key=lambda i: (ids[i], bags[i].tobytes()))
    model = train([bags[i] for i in order], labels[order])
    del got, bags
    release()
    return model


def score(docs: DataFrame, model: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_offending, top_sentence) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n, top = model.score(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(n), pa.array(top)], names=["doc_id", "score", "n_offending", "top_sentence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_offending long, top_sentence double")


def offending_sentences(docs: DataFrame, model: Scorer, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each sentence with a score of ``least`` or more: (doc_id, start, end, score, sentence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "score", "sentence"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        for batch in batches:
            texts = texts_of(batch.column(1))
            _, _, top = model.score(texts)
            found = [(d, a, b, s, t[a:b]) for d, t, m in zip(batch.column(0).to_pylist(), texts, top) if m >= least for a, b, s in model.locate(t) if s >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from tessella.session import table

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "top_sentence")
