"""Quality rules: fixed counts, and calibrated logistic regression over hashed n-grams.

Every text gets the counts of the fixed rules. A text that passes those is judged by a
logistic regression over hashed words and hashed character n-grams (orders 2 to 4), each
averaged over the text, so that scoring is two gathers and two sums over whole batches.
The regression is trained on labelled rows, at most ``sample_docs`` of them with
``sample_chars`` characters together, chosen by hash, three quarters for the weights and one quarter for Platt's calibration. A text is
kept where its probability of good quality reaches ``KEEP``.

Defined results: a null text has no words and so fails; text of any length counts whole;
a document labelled more than once takes its lowest label; labels that are null or name
no document teach nothing; with labels of one kind only, or none, every text that passes
the fixed rules is kept with probability 1; repeated rows score alike; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_sample, in_pieces, release, small_batches, texts_of
from tessella.llm.features import Adam, hash_words, ngrams, platt, sigmoid

WORD_BITS, GRAM_BITS, ORDERS = 16, 12, (2, 3, 4)
#: Fixed thresholds of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP = 50, 50, 0.3
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def rule_counts(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) a row, all words, and each row's number of words."""
    words: list[bytes] = []
    out = np.zeros((len(texts), 5), np.int64)
    for i, t in enumerate(texts):
        own = t.encode("utf-8", "replace").split()
        lines = [x for x in t.split("\n") if x.strip(_SPACES)]
        out[i, :4] = len(own), len(t) - sum(map(t.count, _SPACES)), sum(map(t.count, _SYMBOLS)), len(lines) - len(set(lines))
        words += own
    sizes = out[:, 0]
    if len(words) >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        row = np.repeat(np.arange(len(texts)), sizes)
        starts = np.flatnonzero(row[2:] == row[:-2])
        if len(starts):
            # number pairs, then triples, then triples within a row: exact, without hashes
            _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
            _, triple = np.unique(pair[starts] * len(number) + ids[starts + 2], return_inverse=True)
            _, own, seen = np.unique(row[starts] * (triple.max() + 1) + triple, return_inverse=True, return_counts=True)
            again = starts[seen[own] >= 2]
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[again + k] = True
            out[:, 4] = np.bincount(row[covered], minlength=len(texts))
    return out, words, sizes


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


class Model:
    """Weights of the regression and its calibration; without weights everything passes."""

    def __init__(self, words: np.ndarray | None, grams: np.ndarray | None, offset: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.words, self.grams, self.offset, self.slope, self.shift = words, grams, offset, slope, shift

    def probability(self, texts: list[str], words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.ones(len(texts))
        row = np.repeat(np.arange(len(texts)), sizes)
        margin = np.bincount(row, self.words[hash_words(words, WORD_BITS)], len(texts)) / np.maximum(sizes, 1)
        hashes, at = ngrams(texts, ORDERS, GRAM_BITS, chars=True)
        per_gram = sum(self.grams[h] for h in hashes)
        total = np.bincount(at, minlength=len(texts) + 1)[:-1]
        margin += np.bincount(at, per_gram, len(texts) + 1)[:-1] / np.maximum(total, 1)
        return sigmoid(self.slope * (margin + self.offset) + self.shift)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the fixed rules, and the probability of good quality."""
        counts, p = np.zeros((len(texts), 5), np.int64), np.zeros(len(texts))
        for rows in in_pieces(texts, 1_000_000):
            own = [texts[i] for i in rows]
            counts[rows], words, sizes = rule_counts(own)
            p[rows] = self.probability(own, words, sizes)
        return counts, p


def _training_row(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes, their shares, and the shares of the n-gram hashes."""
    words = text.encode("utf-8", "replace").split()
    h, n = np.unique(hash_words(words, WORD_BITS), return_counts=True)
    hashes, at = ngrams([text], ORDERS, GRAM_BITS, chars=True)
    inside = at == 0
    grams = sum(np.bincount(x[inside], minlength=1 << GRAM_BITS) for x in hashes) / max(1, int(inside.sum()))
    return h, n / max(1, len(words)), grams


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, steps: int = 150, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Weighted logistic loss, both classes alike; every fourth row calibrates."""
    hold = np.arange(len(labels)) % 4 == 3
    use = np.flatnonzero(~hold)
    if len(set(labels[use].tolist())) < 2:
        return Model(None, None)
    sizes = np.array([len(r[0]) for r in rows])
    slot = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    g = np.stack([r[2] for r in rows]).astype(np.float32)
    words, grams, offset = np.zeros(1 << WORD_BITS), np.zeros(1 << GRAM_BITS, np.float32), np.zeros(1)
    mine = ~hold[row]
    slot_u, value_u, row_u = slot[mine], value[mine], row[mine]
    y = labels.astype(float)
    share = y[use].mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * ~hold / len(use)
    adam = Adam([words, grams, offset], rate)
    for _ in range(steps):
        m = np.bincount(row_u, words[slot_u] * value_u, len(rows)) + g @ grams + offset[0]
        gap = (y - sigmoid(m)) * weight
        adam.ascend([np.bincount(slot_u, gap[row_u] * value_u, 1 << WORD_BITS) - decay * words, (gap.astype(np.float32) @ g) - np.float32(decay) * grams, np.array([gap.sum()])])
    m = np.bincount(row, words[slot] * value, len(rows)) + g @ grams + offset[0]
    scale = np.flatnonzero(hold) if len(set(labels[hold].tolist())) == 2 else use
    return Model(words, grams.astype(float), float(offset[0]), *platt(m[scale], y[scale]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 4000, sample_chars: int = 40_000_000) -> Model:
    """Learn from at most ``sample_docs`` labelled rows of at most ``sample_chars`` characters together."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.min("label").alias("label")), ["doc_id"], sample_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_training_row(t) for t in texts_of(batch.column(1))]
            cols = [pa.array([x[k].astype(kind).tobytes() for x in made], pa.binary()) for k, kind in enumerate(("<i4", "<f4", "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "label", "words", "shares", "grams"])

    rows = bounded_sample(rows.select("doc_id", "text", "label"), ["doc_id", "text"], sample_docs, size=F.length("text"), most_size=sample_chars)
    got = rows.mapInArrow(run, "doc_id long, label int, words binary, shares binary, grams binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.grams, r.words))
    made = [(np.frombuffer(r.words, "<i4").astype(np.int64), np.frombuffer(r.shares, "<f4"), np.frombuffer(r.grams, "<f4")) for r in got]
    model = train(made, np.array([int(r.label > 0) for r in got]))
    release()
    return model


def judge(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Counts, probability and verdict of each row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, p = model.judge(texts_of(batch.column(1)))
            failed = base_failed(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    from tessella.session import table

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
