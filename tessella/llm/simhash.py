"""SimHash near-duplicates, linked through pigeonring filtering.

A fingerprint has bit ``b`` where more than half of a document's shingle hashes have it.
Two fingerprints link at ``radius`` or fewer differing bits. Cut into a ring of ``m``
segments, such a pair must have a start segment from which every chain of ``l``
consecutive segments differs in at most ``l * radius / m`` bits. The leading segments of
the chain, whose budget is below one bit, must be equal: they are the join key. The
budgets of the longer chains prune within the join, before the full distance.

Equal fingerprints are one node. Keys shared by more than ``crowd`` nodes are not paired:
their nodes are linked through the points within one bit of them (two fingerprints at
distance two or less always share such a point, and all nodes at one point are within
distance two of each other), which takes rows in proportion to the nodes. This holds for
``radius`` 2; nothing is capped or dropped.

Defined results: a null text is the empty text; a text without words has fingerprint
zero and links like any other; ties and repeated rows share a component; a component's
id is its least doc_id, null only if it has no other; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Workspace, begin_task, bounded_sample, fresh_name, in_pieces, small_batches, texts_of
from tessella.llm.components import connected_components

RADIUS = 2
SEGMENTS = 5
CROWD = 64
#: Of the similarity search: members that an anchor's nodes meet first, documents sampled for common shingles, most of these, bits of the short parities.
HUBS, SAMPLE, COMMON, SHORT = 2, 4000, 100_000, 512
#: Arrays that pairs carry through a join at once: bytes, or this share of the bytes of all nodes' shingle sets if that is more.
TURN, ODD_SHARE, SET_SHARE = 256 << 20, 0.25, 1.0
#: Nodes whose texts are to be compared are broadcast up to this number, 8 bytes each; beyond it they are joined by shuffles.
BROADCAST_NODES = 1_000_000


def _hashes(text: str, width: int) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def _fold(each: list[np.ndarray]) -> np.ndarray:
    """SimHash of each array of hashes, as signed 64-bit integers."""
    out = np.zeros(len(each), dtype=np.uint64)
    full = [k for k, h in enumerate(each) if len(h)]
    if full:
        sizes = np.array([len(each[k]) for k in full])
        bits = np.unpackbits(np.concatenate([each[k] for k in full]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
        out[full] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out.astype(np.int64)


def fingerprints(texts: list[str], width: int = 3, sets: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """SimHash of each text, and with ``sets`` its distinct shingle hashes, ascending."""
    found, distinct = [np.empty(0, np.int64)], []
    for rows in in_pieces(texts, 500_000):
        each = [_hashes(texts[i], width) for i in rows]
        found.append(_fold(each))
        if sets:
            distinct += [np.unique(h.view(np.int64)) for h in each]
    return np.concatenate(found), distinct


def with_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("simhash")
        for batch in batches:
            fp, _ = fingerprints(texts_of(batch.column(2)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _ring(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _chain_mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    mask = 0
    for j in range(length):
        at, width = ring[(start + j) % len(ring)]
        mask |= ((1 << width) - 1) << at
    return mask - (1 << 64) if mask >> 63 else mask


def pigeonring_keys(fp: Column, m: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """One (start, equal bits) key for each start segment of the ring."""
    ring = _ring(m)
    equal = max(n for n in range(m + 1) if n * radius // m == 0)
    return F.array(*(F.struct(F.lit(i).alias("at"), fp.bitwiseAND(F.lit(_chain_mask(ring, i, equal))).alias("bits")) for i in range(m)))


def within_budgets(x: Column, at: Column, m: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """The chain test on ``x``, two fingerprints' difference, for the start segment ``at``."""
    ring = _ring(m)
    test = F.bit_count(x) <= radius
    for length in range(1, m):
        if length * radius // m:
            masks = F.array(*(F.lit(_chain_mask(ring, i, length)) for i in range(m)))
            test = (F.bit_count(x.bitwiseAND(F.get(masks, at))) <= length * radius // m) & test
    return test


def link(work: Workspace, nodes: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``nodes(fp)`` at distance 2 or less."""
    keyed = nodes.select("fp", F.inline(pigeonring_keys(F.col("fp"))))
    met = keyed.groupBy("at", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = work.keep(keyed.join(met, ["at", "bits"]), "shared")
    few = shared.where(F.col("n") <= crowd).drop("n")
    a, b = few.alias("a"), few.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = (F.col("a.at") == F.col("b.at")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, same & within_budgets(x, F.col("a.at"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    balls = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").drop("hi")
    through = balls.join(least, "point").where("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(through)


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of ``docs``."""
    work = Workspace(docs.sparkSession)
    marked = work.keep(with_fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    nodes = work.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("lo")), "nodes")
    roots = connected_components(work, link(work, nodes.select("fp")))
    joined = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "lo")
    least = joined.groupBy("root").agg(F.min("lo").alias("least"))
    linked = work.keep(joined.join(least, "root").select("fp", "least"), "linked")
    # a table of its own, so that the join below has two plain shuffles and a frequent fingerprint can be split
    final = work.keep(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "lo").alias("component_id")), "final")
    return marked.join(final, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _common_shingles(docs: DataFrame, id_col: str, text_col: str, width: int) -> np.ndarray:
    """Shingle hashes that several of ``SAMPLE`` documents share, the most frequent last, at most ``COMMON`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("simhash")
        for batch in batches:
            for text in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(text, width).view(np.int64)))], names=["h"])

    rows = bounded_sample(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id"], SAMPLE)
    found = rows.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array([r.h for r in reversed(found)], dtype=np.int64)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of ``n`` distinct shingles, those of ``common`` last.

    Two sets of Jaccard similarity ``similarity`` or more share ``similarity * n`` of either's
    shingles, so whatever the order, if it is one for all sets, their prefixes meet.
    """
    n = len(shingles)
    if not n:
        return shingles
    order = np.zeros(n, dtype=np.int64)
    if len(common):
        by_hash = np.argsort(common)
        at = np.minimum(np.searchsorted(common[by_hash], shingles), len(common) - 1)
        order = np.where(common[by_hash][at] == shingles, by_hash[at] + 1, 0)
    return shingles[np.argsort(order, kind="stable")][: n - int(np.ceil(similarity * n - 1e-6)) + 1]


def parities(shingles: np.ndarray, classes: int) -> np.ndarray:
    """Whether the number of shingles in each of ``classes`` hash classes is odd, as 64-bit integers.

    ``classes`` is a power of two. A bit in which two sets' parities differ takes a shingle
    that only one of them has.
    """
    odd = np.bincount(shingles & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _long_parities(shingles: np.ndarray) -> np.ndarray | None:
    """Parities in as many classes as shingles or more, for sets that ``SHORT`` bits are too few for."""
    n = len(shingles)
    return parities(shingles, 1 << (n - 1).bit_length()) if n > SHORT else None


_MARKS = "doc_id long, text_hash long, fp long, n long, prefix array<bigint>, odd array<bigint>, " + ", ".join(f"p{k} long" for k in range(SHORT // 64))


def _marks_of(batch: pa.RecordBatch, common: np.ndarray, similarity: float, width: int) -> Iterator[pa.RecordBatch]:
    """The marks of a batch (doc_id, text_hash, text), by runs of rows, so that the sets of few long texts are held at once."""
    names, longs = [f.split()[0] for f in _MARKS.split(", ")], pa.list_(pa.int64())
    texts = texts_of(batch.column(2))
    for rows in in_pieces(texts, 500_000):
        part = batch.slice(rows[0], len(rows))
        fp, sets = fingerprints([texts[i] for i in rows], width, sets=True)
        short = np.stack([parities(x, SHORT) for x in sets])
        cols = [part.column(0), part.column(1), pa.array(fp), pa.array([len(x) for x in sets], pa.int64()), pa.array([prefix(x, similarity, common) for x in sets], longs), pa.array([_long_parities(x) for x in sets], longs)]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(short[:, k]) for k in range(SHORT // 64))], names=names)


def with_prefixes(docs: DataFrame, common: np.ndarray, similarity: float, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, text_hash, fp, n, prefix, odd, p0 and so on) for each row.

    n is the number of distinct shingles; p0 and so on are their parities in ``SHORT`` classes, odd those of long sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("simhash")
        for batch in batches:
            yield from _marks_of(batch, common, similarity, width)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, _MARKS)


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) for the ``texts(node, text)`` whose node is in ``wanted``: all distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("simhash")
        for batch in batches:
            texts = texts_of(batch.column(1))
            for rows in in_pieces(texts, 500_000):
                found = [np.unique(_hashes(texts[i], width).view(np.int64)) for i in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0], len(rows)), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    few = wanted.count() <= BROADCAST_NODES
    one = texts.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return one.mapInArrow(run, "node long, shingles array<bigint>")


def _odd_apart(a: Column, b: Column) -> Column:
    """Bits in which two sets' parities differ; the longer is folded once to the shorter's length."""
    xor = lambda x, y: x.bitwiseXOR(y)
    least = F.least(F.size(a), F.size(b))
    fold = lambda c: F.when(F.size(c) > least, F.zip_with(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least), xor)).otherwise(c)
    return F.aggregate(F.zip_with(fold(a), fold(b), xor), F.lit(0), lambda n, x: n + F.bit_count(x).cast("int"))


class _Search:
    """The nodes of one similarity search, and the tests that a pair of them has to pass."""

    def __init__(self, work: Workspace, texts: DataFrame, nodes: DataFrame, similarity: float, width: int):
        self.work, self.texts, self.nodes, self.similarity, self.width = work, texts, nodes, similarity, width
        self.short = [f"p{k}" for k in range(SHORT // 64)]
        self.set_bytes = 8 * (nodes.agg(F.sum("n")).first()[0] or 0)

    def kept_pairs(self, pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``pairs(a, b, a_n)`` written, and the sum of a_n, taken while they are written."""
        seen = Observation()
        out = self.work.keep(pairs.observe(seen, F.coalesce(F.sum("a_n"), F.lit(0)).alias("sum")), name)
        return out, seen.get["sum"]

    def turns(self, pairs: DataFrame, size: float, share: float) -> list[DataFrame]:
        """``pairs`` in parts by hash, since every pair takes an array of its node a through the join on b.

        ``size`` is the bytes of these arrays. A part's shuffle files go before the next part
        begins, so that the disk holds those of one.
        """
        n = max(1, int(np.ceil(size / max(TURN, share * self.set_bytes))))
        return [pairs.where(F.pmod(F.xxhash64(F.lit(11), "a", "b"), F.lit(n)) == k) for k in range(n)] if n > 1 else [pairs]

    def may_be(self, x: str, y: str) -> Column:
        """Sizes, and the short parities, that a pair of the wanted similarity can have.

        Sets of ``m`` and ``n`` shingles of similarity ``s`` differ in (1 - s) / (1 + s) * (m + n)
        shingles at most, and so in that many parities.
        """
        m, n = F.col(f"{x}n"), F.col(f"{y}n")
        apart = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in self.short), F.lit(0))
        return (F.least(m, n) >= self.similarity * F.greatest(m, n) - 1e-6) & (apart <= self.most_apart(m, n))

    def most_apart(self, m: Column, n: Column) -> Column:
        return (1 - self.similarity) / (1 + self.similarity) * (m + n) + 1e-6

    def alike(self, wanted: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``wanted(a, b, a_n)`` whose whole shingle sets have the similarity; a_n is the shingles of a."""
        pairs, shingles = self.kept_pairs(wanted.distinct(), "wanted")
        odds = self.nodes.where("odd is not null").select("node", "n", "odd")
        # classes differ by more than one doubling only at similarities below 0.5, where nothing goes
        sizes = F.greatest(F.size("a_odd"), F.size("b_odd")) <= 2 * F.least(F.size("a_odd"), F.size("b_odd"))
        far = sizes & (_odd_apart(F.col("a_odd"), F.col("b_odd")) > self.most_apart(F.col("a_len"), F.col("b_len")))
        parts, shingles_near = [], 0
        for some in self.turns(pairs, shingles / 4, ODD_SHARE):  # up to two classes a shingle, 8 in a byte
            marked = some.join(odds.toDF("a", "a_len", "a_odd"), "a", "left").join(odds.toDF("b", "b_len", "b_odd"), "b", "left")
            part, n = self.kept_pairs(marked.where(F.coalesce(~far, F.lit(True))).select("a", "b", "a_n"), "near")
            parts.append(part)
            shingles_near += n
        near = reduce(DataFrame.unionByName, parts)
        self.work.drop(pairs)
        ends = self.work.keep(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "ends")
        sets = self.work.keep(_sets(self.texts, ends, self.width), "sets")
        both = F.size(F.array_intersect("a_set", "b_set"))
        links = []
        for some in self.turns(near, 8 * shingles_near, SET_SHARE):
            read = some.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
            links.append(self.work.keep(read.where(both / (F.size("a_set") + F.size("b_set") - both) >= self.similarity).select("a", "b"), "similar"))
        for part in parts:
            self.work.drop(part)
        self.work.drop(sets)
        return reduce(DataFrame.unionByName, links)


def similar_links(work: Workspace, texts: DataFrame, nodes: DataFrame, known: DataFrame, similarity: float, *, width: int = 5, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that, with ``known``, connect all ``nodes`` of Jaccard similarity ``similarity`` or more.

    ``nodes`` are the distinct texts of ``texts(node, text)`` with the marks of :func:`with_prefixes`.
    Every such pair shares an anchor, a shingle of both prefixes, and passes :meth:`_Search.may_be`.
    The nodes of an anchor first meet ``HUBS`` of them; which ones does not matter for the
    result. Pairs whose nodes the links so far have connected need no comparison; all others
    are compared, an anchor's nodes in blocks, so that no anchor is one task's work.
    """
    search = _Search(work, texts, nodes, similarity, width)
    brief = ["node", "n", *search.short]
    keyed = nodes.select("node", F.explode("prefix").alias("anchor"))
    met = work.keep(keyed.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1").select("anchor"), "met")
    many = work.keep(keyed.join(met, "anchor"), "anchors")
    work.drop(met)
    # the members with most shared anchors first: an original holds more of them than its copies
    central = work.keep(many.groupBy("node").agg(F.count("*").alias("held")), "held")
    drawn = [F.min(F.struct((-F.col("held")).alias("o"), F.xxhash64("node").alias("h"), "node")).alias("hub0")]
    drawn += [F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node")).alias(f"hub{i}") for i in range(1, HUBS)]
    hubs = work.keep(many.join(central, "node").groupBy("anchor").agg(*drawn).select("anchor", F.array(*(F.col(f"hub{i}.node") for i in range(HUBS))).alias("hubs")), "hubs")
    work.drop(central)
    through = work.keep(many.join(hubs, "anchor").select("node", F.explode("hubs").alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "through")
    work.drop(hubs)
    ends = nodes.select(*brief)
    fit = through.join(ends.toDF("a", *(f"a_{c}" for c in brief[1:])), "a").join(ends.toDF("b", *(f"b_{c}" for c in brief[1:])), "b").where(search.may_be("a_", "b_"))
    links = search.alike(fit.select("a", "b", "a_n"))
    work.drop(through)
    roots = connected_components(work, known.unionByName(links))
    rooted = work.keep(many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "anchor_roots")
    work.drop(many)
    mixed = work.keep(rooted.groupBy("anchor").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("anchor", F.ceil(F.col("members") / crowd).cast("long").alias("blocks")), "mixed")
    if mixed.isEmpty():
        return links
    some = work.keep(rooted.join(mixed, "anchor").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks"))), "blocks")
    work.drop(rooted)
    work.drop(mixed)
    parted = work.keep(some.join(ends, "node"), "parted")
    work.drop(some)
    # each block meets every other once, in a cell of its own
    each = parted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = each.select("anchor", "root", "block", *brief, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    x, y = cell.toDF(*(f"x_{c}" for c in cell.columns)), cell.toDF(*(f"y_{c}" for c in cell.columns))
    same = (F.col("x_anchor") == F.col("y_anchor")) & (F.col("x_i") == F.col("y_i")) & (F.col("x_j") == F.col("y_j"))
    once = (F.col("x_block") < F.col("y_block")) | ((F.col("x_i") == F.col("x_j")) & (F.col("x_node") < F.col("y_node")))
    rest = x.join(y, same & (F.col("x_root") != F.col("y_root")) & once & search.may_be("x_", "y_"))
    least_n = F.when(F.col("x_node") < F.col("y_node"), F.col("x_n")).otherwise(F.col("y_n"))
    more = search.alike(rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), least_n.alias("a_n")))
    work.drop(parted)
    return links.unionByName(more)


def _once(marked: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the ids that one row has."""
    return marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("text_hash").alias("text_hash")).where("rows = 1").drop("rows")


def _all_links(work: Workspace, texts: DataFrame, nodes: DataFrame, known: DataFrame | None, similarity: float, width: int, crowd: int) -> DataFrame:
    """Links (a, b) by fingerprint and by similarity between ``nodes``, after ``known`` ones, which are among them."""
    first = work.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    equal = nodes.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    bits = link(work, first.select("fp"), crowd=crowd)
    close = bits.join(first.toDF("a", "a_node"), "a").join(first.toDF("b", "b_node"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    so_far = equal.unionByName(close)
    so_far = work.keep(so_far if known is None else so_far.unionByName(known), "known")
    work.drop(first)
    return so_far.unionByName(similar_links(work, texts, nodes, so_far, similarity, width=width, crowd=crowd))


def group_similar(docs: DataFrame, *, earlier: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component): groups by fingerprint links and by Jaccard similarity of ``similarity`` or more.

    A radius of 2 of 64 bits alone finds few pairs of similarity 0.8, which differ in about
    ten bits; those come from :func:`similar_links`. A node is a distinct text, named by its hash.

    ``earlier`` may hold the documents as they were before they were edited. Where an id has
    one row there and one here, its earlier text is in one group with its text, and earlier
    texts are linked among themselves as texts are: documents group by chains of texts that
    are alike now or were so before. Ids that are null, missing or repeated on either side
    have no earlier text.
    """
    work = Workspace(docs.sparkSession)
    common = _common_shingles(docs if earlier is None else earlier, id_col, text_col, width)
    text = F.col(text_col).cast("string")
    mark = lambda df: work.keep(with_prefixes(df, common, similarity, id_col=id_col, text_col=text_col, width=width), "marks")
    named = lambda df: df.select(F.xxhash64(text).alias("node"), text.alias("text"))
    one_each = lambda df: work.keep(df.withColumnRenamed("text_hash", "node").drop("doc_id").dropDuplicates(["node"]), "nodes")
    marked = mark(docs)
    rows = work.keep(marked.select("doc_id", "text_hash", "fp"), "rows")
    nodes = one_each(marked)
    work.drop(marked)
    links = work.keep(_all_links(work, named(docs), nodes, None, similarity, width, crowd), "links")
    work.drop(nodes)
    if earlier is not None:
        marked = mark(earlier)
        both = work.keep(_once(rows).join(_once(marked).toDF("doc_id", "before"), "doc_id"), "before")
        nodes = one_each(marked.join(both.select(F.col("before").alias("text_hash")).distinct(), "text_hash", "left_semi"))
        work.drop(marked)
        own = both.where("text_hash <> before").select(F.col("text_hash").alias("a"), F.col("before").alias("b"))
        links = work.keep(_all_links(work, named(earlier), nodes, links.unionByName(own), similarity, width, crowd), "links")
        work.drop(nodes)
    roots = work.keep(connected_components(work, links), "roots")
    rooted = work.keep(rows.withColumn("node", F.col("text_hash")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    work.drop(rows)
    least = work.keep(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rooted.join(least, "root").select("doc_id", "text_hash", "fp", "component_id", F.col("root").alias("component"))


def _first_of_each(docs: DataFrame, grouped: DataFrame, component: str, id_col: str, text_col: str) -> DataFrame:
    work = Workspace(docs.sparkSession)
    each = grouped.groupBy(component, "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows")).alias("first")
    keepers = work.keep(each.groupBy(component).agg(first).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_hash").alias("k_hash"), F.col("first.rows").alias("k_rows")), "keepers")
    h = F.xxhash64(F.col(text_col).cast("string"))

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, F.col(id_col).cast("long").eqNullSafe(some["k_id"]) & (h == some["k_hash"]), "left_semi")

    again = keepers.where("k_rows > 1")
    if again.isEmpty():
        return rows_of(keepers)
    key, mark = fresh_name(docs.columns, "row_id"), fresh_name(docs.columns, "row_hash")
    repeated = rows_of(again).withColumn(key, F.col(id_col).cast("long")).withColumn(mark, h)
    return rows_of(keepers.where("k_rows = 1")).unionByName(repeated.dropDuplicates([key, mark]).drop(key, mark))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document of each component of :func:`group`: that with the least id, then text hash."""
    return _first_of_each(docs, group(docs, id_col=id_col, text_col=text_col, width=width), "component_id", id_col, text_col)


def dedup_similar(docs: DataFrame, *, earlier: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each component of :func:`group_similar`: that with the least id, then text hash."""
    return _first_of_each(docs, group_similar(docs, earlier=earlier, id_col=id_col, text_col=text_col, width=width, similarity=similarity), "component", id_col, text_col)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from tessella.session import table

    small_batches(spark)
    out = group(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
