"""Records around answers: event frames, edits, todo lists, id allocation, versions and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import filled

STATUSES = ["pending", "in_progress", "completed"]  # fixed values


def answer_events(answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, seq, event, frame): the server-sent events of each answer, in order.

    ``answers`` has citations (an array of structs, null where retrieval failed), deltas (an
    array of strings, empty ones sent as nothing), backend and error (null where all went well).
    Citations come first, then a frame for each delta; an error gives an error frame; every
    answer ends with a done frame, so that a reader always knows where the stream stops.
    """
    def frame(event: str, data: Column) -> Column:
        body = F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(data), F.lit("\n\n"))
        return F.struct(F.lit(event).alias("event"), body.alias("frame"))

    sent = F.filter("deltas", lambda x: filled(x) != "")
    failed = F.col("error").isNotNull()
    head = F.when(F.col("citations").isNotNull(), F.array(frame("citations", F.col("citations"))))
    body = F.transform(sent, lambda x: frame("answer", F.struct(x.alias("delta"))))
    fault = F.when(failed, F.array(frame("error", F.struct(F.lit("RAG_INTERNAL_ERROR").alias("error_code"), F.col("error").alias("message")))))
    done = F.when(failed, F.array(frame("done", F.struct(F.lit("error").alias("backend_used"))))).otherwise(F.array(frame("done", F.struct(F.array_join(sent, "").alias("answer"), F.col("backend").alias("backend_used")))))
    none = F.array().cast("array<struct<event:string,frame:string>>")
    frames = F.concat(F.coalesce(head, none), F.coalesce(body, none), F.coalesce(fault, none), done)
    return answers.select(*key, F.posexplode(frames).alias("seq", "each")).select(*key, "seq", "each.event", "each.frame")


def multi_edit(text: Column, edits: list[tuple[str, str]]) -> Column:
    """Struct (text, failed, matches): every edit applied, or none.

    Each old string must occur exactly once in the text as it was; ``failed`` is the place of
    the first edit for which it does not, with its number of matches, and ``text`` is null then.
    Edits are applied in order. A null text counts as empty; an empty old string never matches once.
    """
    body = filled(text)

    def hits(old: str) -> Column:
        if not old:
            return F.length(body) + 1
        return F.floor((F.length(body) - F.length(F.replace(body, F.lit(old), F.lit("")))) / len(old))

    counts = F.array(*(hits(old).cast("long") for old, _ in edits))
    wrong = F.filter(F.transform(counts, lambda n, i: F.struct(i.cast("int").alias("failed"), n.alias("matches"))), lambda s: s["matches"] != 1)
    out = body
    for old, new in edits:
        out = F.replace(out, F.lit(old), F.lit(new))
    first = F.get(wrong, F.lit(0))
    return F.struct(F.when(F.size(wrong) == 0, out).alias("text"), first["failed"].alias("failed"), first["matches"].alias("matches"))


def todo_report(todos: DataFrame, key: str, *, shown: int = 3) -> DataFrame:
    """(key, total, fault, fault_at, recap) of each todo list.

    ``todos`` has place (from 0), content and status. ``fault`` is the first rule broken:
    ``in_progress`` where more than one item is in progress, else ``content`` or ``status``
    at the first item (``fault_at``) that is blank or has an unknown status. The recap counts
    what is done, and names the item in progress and the first few pending ones.
    """
    status, content = filled(F.col("status")), filled(F.col("content"))
    blank, unknown = F.trim(content) == "", ~status.isin(STATUSES)
    now = status == "in_progress"
    bad = F.when(blank, "content").when(unknown, "status")
    stats = todos.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(status == "completed").alias("done"), F.count_if(now).alias("busy"), F.count_if(status == "pending").alias("waiting"),
        F.min(F.when(bad.isNotNull(), F.struct("place", bad.alias("rule")))).alias("bad"), F.min(F.when(now, F.struct("place", content.alias("content")))).alias("current"))
    w = Window.partitionBy(key).orderBy("place")
    next_up = todos.where(status == "pending").select(key, "place", content.alias("content")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown)
    named = next_up.groupBy(F.col(key).alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), "; ").alias("pending"))
    tally = F.format_string("[%d/%d]", "done", "total")
    rest = F.when(F.col("waiting") > shown, F.concat(F.lit("还有 "), (F.col("waiting") - shown).cast("string"), F.lit(" 个...")))
    busy = F.when(F.col("current").isNotNull(), F.concat(F.lit("进行中: "), F.col("current.content")))
    recap = F.when(F.col("done") == F.col("total"), F.concat(F.lit("✅ "), tally, F.lit(" 所有任务已完成！"))).otherwise(F.concat_ws(". ", F.concat(F.lit("📋 "), tally), busy, F.concat(F.lit("待处理: "), F.col("pending")), rest))
    over = F.col("busy") > 1
    joined = stats.join(named, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, "total", F.when(over, "in_progress").otherwise(F.col("bad.rule")).alias("fault"), F.when(~over, F.col("bad.place")).alias("fault_at"), recap.alias("recap"))


#: Documents are numbered bucket by bucket, so that no task sees more than its share of them.
ID_BUCKETS = 256


def allocate_ids(docs: DataFrame, key: str, count: str, start: int = 0) -> DataFrame:
    """``docs`` with first_chunk and last_chunk: ``count`` consecutive ids each, from ``start`` on, without gaps.

    Documents take their turn by the first byte of the MD5 of their key, and then by key, which
    must be unique; a null key counts as the empty one in that. Only one number for each of the
    256 buckets is summed up in one place. A document of no chunks has a last id below its first.
    """
    text = filled(F.col(key).cast("string"))
    placed = docs.withColumn("_b", F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int"))
    totals = placed.groupBy("_b").agg(F.sum(count).alias("_n"))  # 256 rows at most
    base = totals.select(F.col("_b"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    before = F.sum(count).over(Window.partitionBy("_b").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(count)
    first = (F.lit(start) + F.col("_base") + before).cast("long")
    out = placed.join(F.broadcast(base), "_b").withColumn("first_chunk", first)
    return out.withColumn("last_chunk", F.col("first_chunk") + F.col(count) - 1).drop("_b", "_base")


def next_id(registry: DataFrame) -> DataFrame:
    """One row: the id after the largest that a registered document holds; 0 for an empty registry."""
    return registry.agg(F.coalesce(F.max("last_chunk") + 1, F.lit(0)).cast("long").alias("next_id"))


def locked_update(held: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, version, outcome): optimistic updates of rows by version.

    ``held`` has key, value and version, one row a key; ``changes`` has key, value and seen, one
    row a key. A change is ``updated`` where the version it has seen still stands, which adds one
    to it, and a ``CONFLICT`` where it does not: the row then stays as it is. Keys that are not
    held are ``NOT_FOUND``, with nulls; rows without a change are ``kept``.
    """
    new = changes.select(F.col(key).alias("_key"), F.col(value).alias("_new"), F.col("seen").alias("_seen"), F.lit(True).alias("_asked"))
    old = held.select(key, value, "version", F.lit(True).alias("_held"))
    both = old.join(new, F.col(key).eqNullSafe(F.col("_key")), "full")
    here, asked = F.col("_held").isNotNull(), F.col("_asked").isNotNull()
    fits = here & asked & F.col("version").eqNullSafe(F.col("_seen"))
    outcome = F.when(~here, "NOT_FOUND").when(fits, "updated").when(asked, "CONFLICT").otherwise("kept")
    return both.select(F.when(here, F.col(key)).otherwise(F.col("_key")).alias(key), F.when(fits, F.col("_new")).otherwise(F.col(value)).alias(value), F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"), outcome.alias("outcome"))


def training_sets(candidates: DataFrame, negatives: DataFrame, *, hard: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pointwise (query_id, doc, label), pairwise (query_id, positive, negative) and preference (query_id, chosen, rejected) rows.

    ``candidates`` are the blocks shown for each query: query_id, place, doc, label (0 to 2 or
    null) and positive, which is true for one of them. ``negatives`` has query_id, part, place
    and doc; parts come in order, the hard ones first, and the other candidates follow them.
    Labels of a query count only where each of its candidates has one; otherwise the positive
    has 2 and the others 0. A negative is a text that is not the positive's and has not come
    before for its query; preference pairs take the first ``hard`` + 1. Queries with one
    candidate, or without a positive or a negative, give nothing.
    """
    groups = candidates.groupBy("query_id").agg(F.count("*").alias("_n"), F.count("label").alias("_labelled"), F.max(F.when(F.col("positive"), F.col("doc"))).alias("_positive"))
    asked = groups.where("_n >= 2 and _positive is not null")
    others = candidates.where(~F.coalesce("positive", F.lit(False))).select("query_id", F.lit("others").alias("part"), "place", "doc")
    rank = F.when(F.col("part") == "hard", 0).when(F.col("part") == "random", 1).otherwise(2)
    every = negatives.select("query_id", "part", "place", "doc").unionByName(others).join(asked.select("query_id", "_positive"), "query_id").where(F.col("doc") != F.col("_positive"))
    first = every.groupBy("query_id", "doc").agg(F.min(F.struct(rank.alias("rank"), "place")).alias("at"), F.first("_positive").alias("positive"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc"))  # the blocks of one query
    ordered = first.withColumn("nth", order)
    label = F.when(F.col("_labelled") == F.col("_n"), F.col("label")).otherwise(F.when(F.col("positive"), 2).otherwise(0)).cast("int")
    used = asked.join(first.select("query_id").distinct(), "query_id", "left_semi")
    pointwise = candidates.join(used, "query_id").select("query_id", "doc", label.alias("label"))
    pairwise = ordered.select("query_id", "positive", F.col("doc").alias("negative"))
    preference = ordered.where(F.col("nth") <= hard + 1).select("query_id", F.col("positive").alias("chosen"), F.col("doc").alias("rejected"))
    return pointwise, pairwise, preference


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of every value of some columns; values as text, null as null."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(each)).groupBy("column", "value").agg(F.count("*").alias("n"))
