"""Language identification by hierarchical discrimination.

The language family is predicted first, by one-against-the-rest linear support vector
machines over hashed byte n-grams; then one-versus-one machines separate the languages
of that family. Margins become probabilities by Platt's scaling on rows kept from
training. Training uses at most ``sample_docs`` rows, drawn alike from each language by
hash; scoring is one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text of
any length counts whole; rows whose language is null teach nothing; with no row to learn
from every text is ``und``; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import begin_task, bounded_sample, held_out, in_pieces, release, small_batches, texts_of
from tessella.llm.features import Adam, ngram_counts, platt, sigmoid

UND = "und"
ORDERS, BITS = (1, 2, 3), 12
_LETTER = re.compile(r"[^\W\d_]")
#: Language families by ISO 639-1 code; a code that is not listed is a family alone.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower(), lang)


def vectors(texts: list[str]) -> np.ndarray:
    """Unit-length roots of n-gram counts."""
    x = np.sqrt(ngram_counts(texts, ORDERS, BITS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Machine:
    """A linear support vector machine and its scaling."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights + self.offset) + self.shift)


def fit_machine(x: np.ndarray, y: np.ndarray, among: np.ndarray | None = None, *, steps: int = 100, decay: float = 1e-4) -> Machine:
    """Squared-hinge loss with classes weighted alike, over the rows ``among``; every fourth of them is kept for the scaling."""
    among = np.ones(len(y), bool) if among is None else among
    turn = np.cumsum(among) - 1
    kept = among & (turn % 4 == 3) if among.sum() >= 40 else np.zeros(len(y), bool)
    use = among & ~kept if len(set(y[among & ~kept].tolist())) == 2 else among
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    # rows that are not used weigh nothing, so that no part of x is copied
    weight = (np.where(y, 0.5 / max(1, (use & y).sum()), 0.5 / max(1, (use & ~y).sum())) * use).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.zeros(1, np.float32)
    adam = Adam([w, b], 0.1)
    for _ in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ w + b[0])) * sign * weight
        adam.ascend([x.T @ slack - decay * w, np.array([slack.sum()])])
    scale = kept if len(set(y[kept].tolist())) == 2 else use
    return Machine(w, float(b[0]), *platt((x @ w + b[0])[scale].astype(np.float64), y[scale].astype(float)))


class Identifier:
    """Family machines, and the pairs of languages within each family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.members.setdefault(family(lang), []).append(lang)
        self.families = sorted(self.members)
        own = np.array([family(lang) for lang in y])
        self.first = {f: fit_machine(x, own == f) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                self.pairs[a, b] = fit_machine(x, y == a, (y == a) | (y == b))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.families:
            return langs, scores
        for rows in in_pieces(texts, 500_000):
            own = [texts[i] for i in rows]
            x = vectors(own)
            if self.first:
                p = np.stack([self.first[f].probability(x) for f in self.families], axis=1)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
            else:
                p = np.ones((len(own), 1))
            best, sure = p.argmax(axis=1), p.max(axis=1)
            for k, f in enumerate(self.families):
                at = np.flatnonzero(best == k)
                if not len(at):
                    continue
                names = self.members[f]
                votes = np.zeros((len(at), len(names)))
                for a, b in combinations(range(len(names)), 2):
                    q = self.pairs[names[a], names[b]].probability(x[at])
                    votes[:, a] += q
                    votes[:, b] += 1 - q
                share = votes.max(axis=1) / (len(names) - 1) if len(names) > 1 else np.ones(len(at))
                for j, pick, s in zip(at.tolist(), votes.argmax(axis=1).tolist(), share.tolist()):
                    if _LETTER.search(own[j]):
                        langs[rows[j]], scores[rows[j]] = names[pick], sure[j] * s
        return langs, scores


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 4000, most_langs: int = 200) -> Identifier:
    """Learn from at most ``sample_docs`` rows that :func:`held_out` does not mark, of the ``most_langs`` most frequent languages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r.lang: r.n for r in counted.collect()}
    if not sizes:
        return Identifier([], np.zeros((0, 1 << BITS)), np.array([], dtype=str))
    each = max(1, sample_docs // len(sizes))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = F.when(F.col("lang") == lang, draw < int((1 << 30) * min(1.0, each / n))).otherwise(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for piece in in_pieces(texts, 1_000_000):
                x = vectors([texts[i] for i in piece]).astype("<f2")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(piece)), batch.column(2).take(pa.array(piece)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    drawn = bounded_sample(known.where(chosen), ["doc_id", "text", "lang"], sample_docs + len(sizes) * 100)
    got = drawn.mapInArrow(run, "doc_id long, lang string, x binary").toArrow()
    ids, langs = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    order = sorted(range(got.num_rows), key=lambda i: (ids[i] is None, ids[i] or 0, langs[i], i))
    x = np.empty((got.num_rows, 1 << BITS), np.float32)
    place = np.argsort(order)
    for i, v in enumerate(got.column("x")):
        x[place[i]] = np.frombuffer(v.as_buffer(), "<f2")
    y = np.array([langs[i] for i in order])
    del got
    release()
    made = Identifier(sorted(set(y.tolist())), x, y)
    del x
    release()
    return made


def identify(docs: DataFrame, model: Identifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("langid")
        for batch in batches:
            langs, scores = model.predict(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Identifier, *, text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more.

    The column ``lang_col``, where there is one, gets the predicted language; others stay as
    they are. Null texts and texts without a letter go; repeated rows fare alike; no rows
    give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("langid")
        for batch in batches:
            langs, scores = model.predict(texts_of(batch.column(batch.schema.names.index(text_col))))
            if lang_col in batch.schema.names:
                i = batch.schema.names.index(lang_col)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(langs, batch.schema.field(i).type))
            yield batch.filter(pa.array([lang != UND and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    own = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if lang_col in docs.columns:
        own = own.withColumn(lang_col, F.col(lang_col).cast("string"))
    return own.mapInArrow(run, own.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from tessella.session import table

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
