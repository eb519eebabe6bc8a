"""Line deduplication by a segment-partition edit join.

Lines within ``threshold`` edits of each other are linked, linked lines form classes, and
of each class only the first line, by doc_id and place, stays in its document.

Any two lines within ``t`` edits share a segment when one is cut into ``t + 1`` near-equal
segments and the other is probed with substrings of the same length near the same place.
Each line gives the keys of its own segments, and, for every length from ``t`` less than
its own up to its own, the keys of the substrings that the length difference and the
number of the segment allow (the multi-match-aware windows). Keys found in one line only
are dropped by a single aggregation that keeps two numbers a key, so copies of a line and
frequent keys combine before the shuffle. The few lines with a shared key are fetched
with their texts, paired within the key, thinned inside the join by a signature of bigram
parities (an edit changes four bits at most), and verified by a banded bit-parallel edit
distance: one word for each number of errors, one bit for each diagonal of the band.

Only DataFrame functions run. Lines shorter than ``least_chars`` are compared exactly;
lines without a word are never touched. Exact comparison uses 128 bits of hash.

Defined results: a null text stays null, an empty one empty; lines of any length count
whole; rows that repeat both doc_id and text count as one document and keep the same
lines; a class of lines is a connected component of edit links; equal ids with other texts are ordered by the hash of the text, null ids first;
no rows give no rows; columns other than the text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Workspace, fresh_name
from tessella.llm.components import connected_components

THRESHOLD = 2
LEAST_CHARS = 20
#: Shared keys are broadcast up to this number, 8 bytes each; beyond it they are joined by shuffles.
BROADCAST_KEYS = 1_000_000
_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, pos, line, h1, h2) of each line with a word."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(_WORD)).select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def windows(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring that can meet a segment of the shorter line."""
    out = []
    for diff in range(threshold + 1):
        for i in range(threshold + 1):
            low = max(-i, diff - (threshold - i))
            high = min(i, diff + (threshold - i))
            out += [(diff, i, shift) for shift in range(low, high + 1)]
    return out


def fixed_width(line: Column) -> Column:
    """A line in four bytes a character, so that a substring is found without counting from the start."""
    return F.encode(line, "UTF-32")


def segment_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` with a row for each (key, own): its segments, and its substrings that can meet a shorter line's.

    Wants a column ``units``, a :func:`fixed_width` line, and takes it away. The windows are
    rows before the key is computed, so that the generated code holds one key, not all.
    """
    parts = threshold + 1
    each = F.array(*(F.struct(F.lit(diff).alias("diff"), F.lit(i).alias("seg"), F.lit(shift).alias("shift")) for diff, i, shift in windows(threshold)))
    n = F.floor(F.length("units") / 4).cast("int")
    length = n - F.col("diff")
    size = F.floor(length / parts).cast("int")
    short = parts - (length - size * parts)  # so many segments have ``size``, the others one more
    begin = F.col("seg") * size + F.greatest(F.lit(0), F.col("seg") - short) + 1 + F.col("shift")
    width = size + (F.col("seg") >= short).cast("int")
    key = F.xxhash64(length, "seg", F.substr("units", (begin - 1) * 4 + 1, width * 4))
    own = (F.col("diff") == 0) & (F.col("shift") == 0)
    rest = [c for c in lines.columns if c != "units"]
    wide = lines.select("*", F.inline(each)).where((begin >= 1) & (begin + width - 1 <= n))
    return wide.select(*rest, key.alias("key"), own.alias("own"))


def bigram_parity(line: Column) -> Column:
    """64 bits: for each class of bigrams, whether the line has an odd number of them."""
    powers = F.array(*(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))

    def folded(c: Column) -> Column:
        bits = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: F.get(powers, F.xxhash64(x, y).bitwiseAND(63).cast("int")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))

    return F.transform(F.array(F.split(line, "")), folded)[0]


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines are within ``threshold`` edits, by banded bit-parallel automata.

    Bit ``d`` of word ``e`` after column ``j`` says that the first ``j`` characters of ``b``
    can be turned into the first ``j + d - threshold`` of ``a`` with ``e`` errors or fewer.
    """
    t, band = threshold, 2 * threshold + 1
    full = (1 << band) - 1
    names = [f"r{e}" for e in range(t + 1)]
    start = F.struct(*(F.lit(sum(1 << (t + d) for d in range(e + 1))).alias(n) for e, n in enumerate(names)))

    def run(ab: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            own = F.get(ab["b"], j - 1)
            equal = sum((F.when(F.get(ab["a"], j - 1 + d - t) == own, 1 << d).otherwise(0) for d in range(1, band)), F.when(F.get(ab["a"], j - 1 - t) == own, 1).otherwise(0))

            def levels(m: Column) -> Column:
                now = [state["r0"].bitwiseAND(m)]
                for e in range(1, t + 1):
                    was = state[names[e - 1]]
                    less = state[names[e]].bitwiseAND(m).bitwiseOR(was).bitwiseOR(F.shiftright(was, 1))
                    now.append(less.bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND(full))
                return F.struct(*(x.alias(n) for x, n in zip(now, names)))

            return F.transform(F.array(equal), levels)[0]

        columns = F.when(F.size(ab["b"]) > 0, F.sequence(F.lit(1), F.size(ab["b"]))).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(columns, start, step, lambda s: s[names[t]])
        at = F.size(ab["a"]) - F.size(ab["b"]) + t
        powers = F.array(*(F.lit(1 << d) for d in range(band)))
        return F.when((at >= 0) & (at < band), last.bitwiseAND(F.get(powers, at)) != 0).otherwise(False)

    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    return F.transform(F.array(F.struct(chars(a).alias("a"), chars(b).alias("b"))), run)[0]


def link_lines(work: Workspace, lines: DataFrame, *, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Links (a, b) between the ids of different lines within ``threshold`` edits.

    ``lines`` has line, h1 and h2, repeats included; an id is both hashes in hexadecimal.
    """
    fuzzy = lines.where(F.length("line") >= max(least_chars, threshold + 1)).select("h1", "h2", "line")

    def with_keys(some: DataFrame) -> DataFrame:
        return segment_keys(some.select("h1", "h2", "line", fixed_width(F.col("line")).alias("units")), threshold)

    keyed = with_keys(fuzzy)
    per_key = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    shared = work.keep(per_key.where("lo <> hi").select("key"), "keys")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
        found = keyed.join(shared, "key")
    else:  # find the lines by their hashes first, so that texts are shuffled once and not with every key
        some = keyed.select("key", "h1").join(shared, "key").select("h1").distinct()
        picked = fuzzy.join(some, "h1", "left_semi")
        found = with_keys(picked).join(shared, "key")
    one = found.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.collect_set(F.struct("key", "own")).alias("keys"))
    line_id = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    members = work.keep(one.select(line_id.alias("id"), "line", "keys", bigram_parity(F.col("line")).alias("sig")), "members")
    each = members.select("id", "sig", F.inline("keys"))
    a, b = each.where("own").alias("a"), each.alias("b")
    apart = (F.col("a.id") < F.col("b.id")) | ((F.col("a.id") > F.col("b.id")) & ~F.col("b.own"))
    close = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= 4 * threshold
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & close).select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()
    pairs = work.keep(pairs, "pairs")
    texts = members.select("id", "line")
    read = pairs.join(texts.toDF("u", "u_line"), "u").join(texts.toDF("v", "v_line"), "v")
    return read.where(within_edits(F.col("u_line"), F.col("v_line"), threshold)).select("u", "v")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, drop, first_doc, links) for each document that has a line that is linked or repeats an earlier one.

    drop holds the places of the lines that repeat an earlier one, first_doc the least
    doc_id whose line is the first of a class that one of its lines belongs to, links the
    number of different lines within ``threshold`` edits of its lines, summed.
    """
    work = Workspace(docs.sparkSession)
    lines = _lines(docs, id_col, text_col)
    placed = work.keep(lines.select("doc_id", "text_hash", "pos", "h1", "h2"), "places")
    links = work.keep(link_lines(work, lines, threshold=threshold, least_chars=least_chars), "line_links")
    roots = connected_components(work, links)
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    half = lambda name, at: F.conv(F.substring(name, at, 16), 16, -10).cast("long")
    joined = roots.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node")
    moved = work.keep(joined.select(half("node", 1).alias("h1"), half("node", 17).alias("h2"), half("root", 1).alias("r1"), half("root", 17).alias("r2"), "degree"), "moved")
    classed = work.keep(placed.join(moved, ["h1", "h2"], "left").select("doc_id", "text_hash", "pos", F.coalesce("r1", "h1").alias("c1"), F.coalesce("r2", "h2").alias("c2"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")), "classed")
    work.drop(placed)
    work.drop(moved)
    place = F.struct("doc_id", "text_hash", "pos")
    # a table of its own, so that the join below has two plain shuffles and a frequent line can be split
    first = work.keep(classed.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = classed.join(first, ["c1", "c2"]).select("doc_id", "text_hash", "degree", F.col("first.doc_id").alias("first_doc"), F.when(~place.eqNullSafe(F.col("first")), F.col("pos")).alias("pos"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"), F.min("first_doc").alias("first_doc"), F.sum("degree").alias("links"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, dropped: str | None = None, joined: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with later repeats of a line removed from the texts.

    ``dropped`` names a column for their number; ``joined`` may name columns for first_doc
    and links of :func:`repeats`, which are the own id and 0 where nothing is linked.
    """
    work = Workspace(docs.sparkSession)
    found = work.keep(repeats(docs, id_col=id_col, text_col=text_col, threshold=threshold, least_chars=least_chars).toDF("r_id", "r_hash", "r_drop", "r_first", "r_links"), "repeats")
    h = fresh_name(docs.columns, "row_hash")
    marked = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    met = marked.join(found, marked[id_col].cast("long").eqNullSafe(F.col("r_id")) & (marked[h] == F.col("r_hash")), "left")
    text = F.col(text_col).cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("r_drop", i)), "\n")
    new = F.when(F.coalesce(F.size("r_drop"), F.lit(0)) <= 0, text).otherwise(kept)
    out = [new.alias(c) if c == text_col else marked[c] for c in docs.columns]
    if dropped:
        out.append(F.greatest(F.coalesce(F.size("r_drop"), F.lit(0)), F.lit(0)).cast("long").alias(dropped))
    for name, value in (joined or {}).items():
        out.append({"first_doc": F.coalesce("r_first", marked[id_col].cast("long")), "links": F.coalesce("r_links", F.lit(0)).cast("long")}[name].alias(value))
    return met.select(*out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document, size and digest of what stays, its class of lines and their links."""
    from tessella.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, dropped="n_dropped", joined={"first_doc": "class_id", "links": "n_links"})
    return out.select("doc_id", "class_id", "n_links", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
