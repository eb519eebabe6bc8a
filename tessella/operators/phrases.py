"""Phrase mining: frequent n-grams within sentences, and filters over phrases."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.retrieval import CHARS, in_slices
from tessella.work import Workspace, small_batches

#: Units whose pairs are counted first; units and pairs that may be part of a frequent phrase, beyond which all phrases are counted; counts that a task holds.
FIRST, MOST_UNITS, MOST_PAIRS, HELD = 2048, 200_000, 1_000_000, 200_000


def _unit(words: bool) -> str:
    return "[A-Za-z]+" if words else "[一-鿿]"


def _all_phrases(docs: DataFrame, text: Column, low: int, high: int, words: bool) -> DataFrame:
    """(phrase, freq) of all n-grams."""
    sentence = F.explode(F.split(T.filled(text), T.SENTENCE_BREAK)).alias("s")
    units = docs.select(sentence).select(F.regexp_extract_all("s", F.lit(f"({_unit(words)})"), 1).alias("u")).where(F.size("u") >= low)

    def grams(n: int) -> Column:
        starts = F.when(F.size("u") >= n, F.sequence(F.lit(1), F.size("u") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("u", i, n), " " if words else ""))

    return units.select(F.explode(F.concat(*(grams(n) for n in range(low, high + 1)))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("freq"))


def _counted(texts: DataFrame, pattern: str, count: Callable[[list[str], Counter], None]) -> DataFrame:
    """(phrase, freq): what ``count`` adds to a counter for the units and breaks of a run of texts, summed; a task holds a bounded part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "n"])
        for batch in batches:
            for some in in_slices(pc.utf8_length(batch.column(0)).to_pylist(), CHARS):
                count(find("\n".join(batch.column(0).slice(some.start, some.stop - some.start).to_pylist())), seen)
                if len(seen) >= HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(run, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("freq"))


def _ids(found: list[str], at: dict[str, int]) -> np.ndarray:
    """Numbers of the units in ``at``; breaks and other units are -1."""
    get = at.get
    return np.fromiter((get(x, -1) for x in found), np.int64, len(found))


def _pairs(texts: DataFrame, pattern: str, units: list[str]) -> DataFrame:
    """(pair, freq) of the pairs of neighbours that are both in ``units``; the pair of a and b is a times their number plus b."""
    at, n = {u: i for i, u in enumerate(units)}, len(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        dense, held = (np.zeros(n * n, np.int64), []) if n <= FIRST else (None, [])

        def sparse() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for some in in_slices(pc.utf8_length(batch.column(0)).to_pylist(), CHARS):
                x = _ids(find("\n".join(batch.column(0).slice(some.start, some.stop - some.start).to_pylist())), at)
                codes = (x[:-1] * n + x[1:])[(x[:-1] >= 0) & (x[1:] >= 0)]
                if dense is not None:
                    dense += np.bincount(codes, minlength=n * n)
                    continue
                held.append(codes)
                if sum(map(len, held)) > 1 << 22:
                    yield sparse()
                    held = []
        if dense is not None:
            full = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(dense[full])], names=["pair", "n"])
        elif held:
            yield sparse()

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("freq"))


def _least(counts: DataFrame, most: int) -> int:
    """The frequency of the ``most``-th row, 1 where there are fewer."""
    top = counts.orderBy(F.desc("freq")).limit(most).select("freq").collect()
    return top[-1].freq if len(top) == most else 1


def _frequent(work: Workspace, texts: DataFrame, high: int, most: int, words: bool) -> DataFrame | None:
    """(phrase, freq) of n-grams from pairs up to ``high`` units, among them the ``most`` frequent; None where too many may be.

    A phrase is at most as frequent as each of its units and pairs. The pairs of the most
    frequent units are real phrases, so that their ``most``-th frequency is one that the result
    has at least: only units, then pairs, then phrases of such pairs can reach it.
    """
    pattern = f"{_unit(words)}|{T.SENTENCE_BREAK}"
    units = work.keep(_counted(texts, _unit(words), lambda found, seen: seen.update(found)).withColumnRenamed("phrase", "unit"), "units")
    first = [r.unit for r in units.orderBy(F.desc("freq"), "unit").limit(FIRST).collect()]
    pairs = work.keep(_pairs(texts, pattern, first), "pairs")
    few = units.where(F.col("freq") >= _least(pairs, most))
    n = few.count()
    if n > MOST_UNITS:
        return None
    if n > FIRST:
        first = [r.unit for r in few.select("unit").collect()]
        pairs = work.keep(_pairs(texts, pattern, first), "pairs")
    near = pairs.where(F.col("freq") >= _least(pairs, most))
    if near.count() > MOST_PAIRS:
        return None
    at, n = {u: i for i, u in enumerate(first)}, len(first)
    good = np.sort(np.array([r.pair for r in near.select("pair").collect()], dtype=np.int64))
    join = (" " if words else "").join

    def count(found: list[str], seen: Counter) -> None:
        x = _ids(found, at)
        codes = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] * n + x[1:], -1)
        if not len(codes) or not len(good):
            return
        run = good[np.minimum(np.searchsorted(good, codes), len(good) - 1)] == codes
        for size in range(2, high + 1):
            seen.update(join(found[i : i + size]) for i in np.flatnonzero(run).tolist())
            # where a run of pairs goes on by one more
            run = run[:-1] & (good[np.minimum(np.searchsorted(good, codes[size - 1 :]), len(good) - 1)] == codes[size - 1 :])

    return _counted(texts, pattern, count)


def frequent_phrases(docs: DataFrame, text: Column, *, lengths: tuple[int, int] = (2, 5), most: int = 500, words: bool = False) -> DataFrame:
    """(phrase, freq): most frequent n-grams of CJK characters, or of Latin words; ties in order of the phrase. Written as a work table."""
    low, high = lengths
    work = Workspace(small_batches(docs.sparkSession))
    counted = _frequent(work, docs.select(T.filled(text).alias("text")), high, most, words) if low == 2 else None
    if counted is None:
        counted = _all_phrases(docs, text, low, high, words)
    return work.keep(counted.orderBy(F.desc("freq"), "phrase").limit(most), "phrases")


def _parts(phrases: DataFrame) -> DataFrame:
    """(part, longer, longer_freq): every proper substring of every phrase.

    Containment becomes an equality of strings, so that it joins on a key.
    """
    n = F.length("phrase")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col("phrase"), i, k))))
    rows = phrases.select(F.col("phrase").alias("longer"), F.col("freq").alias("longer_freq"), F.explode(F.array_distinct(spans)).alias("part"))
    return rows.where(F.length("part") < F.length("longer"))


def longest_only(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer phrase contains."""
    return phrases.join(_parts(phrases).select(F.col("part").alias("phrase")).distinct(), "phrase", "left_anti")


def frequent_ratio(phrases: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Phrases without a containing phrase of at least ``ratio`` times their frequency."""
    longer = _parts(phrases).groupBy(F.col("part").alias("phrase")).agg(F.max("longer_freq").alias("top"))
    return phrases.join(longer, "phrase", "left").where(F.col("top").isNull() | (F.col("top") < ratio * F.col("freq"))).select("phrase", "freq")


def dictionary_lines(phrases: DataFrame) -> DataFrame:
    """Lines of a segmenter's dictionary."""
    return phrases.select(F.concat_ws(" ", "phrase", F.col("freq").cast("string"), F.lit("n")).alias("value"))
