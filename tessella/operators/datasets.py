"""Knowledge blocks, evaluation cases and training pairs from tables of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Placeholders that the full variant takes out by name.
NAMED_PLACEHOLDERS = ["order number", "account type", "invoice number", "product name", "refund id", "payment method"]


def _summary(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def knowledge_blocks(qa: DataFrame, *, per_group: int | None = 50, least: int = 5, summary: int = 100, named: list[str] | None = None) -> DataFrame:
    """One block a distinct question of (pos, category, intent, instruction, response).

    The first ``per_group`` rows of a group by ``pos``, then questions of ``least``
    characters or more, then the first of each normal form: by group and position, or, with
    ``named`` placeholders, by position alone.
    """
    rows = qa.select("pos", "category", "intent", F.trim("instruction").alias("instruction"), F.trim("response").alias("response"))
    if per_group is not None:
        w = Window.partitionBy("category", "intent").orderBy("pos")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n")
    if named is None:
        normal = F.trim(F.regexp_replace(F.lower("instruction"), r"\{\{.*?\}\}", ""))
    else:
        normal = F.lower("instruction")
        for name in named:
            normal = F.replace(normal, F.lit("{{" + name.lower() + "}}"), F.lit(""))
        normal = F.trim(F.replace(F.replace(normal, F.lit("{{"), F.lit("")), F.lit("}}"), F.lit("")))
    rows = rows.where(F.length("instruction") >= least).withColumn("_k", normal)
    first = rows.groupBy("_k").agg(F.min(F.struct("category", "intent", "pos") if named is None else F.struct("pos")).alias("_f")).select("_k", F.col("_f.pos").alias("pos"))
    kept = rows.join(first, ["_k", "pos"], "left_semi")
    return kept.select(
        "pos",
        F.concat(F.lit("Customer Question: "), "instruction", F.lit("\nSupport Answer: "), "response").alias("text"),
        F.concat("category", F.lit(" - "), "intent").alias("title"),
        F.concat(F.lit("Customer Support - "), "category").alias("page_name"),
        _summary(F.col("response"), summary).alias("summary"),
        "category",
        "intent",
    )


def evaluation_cases(qa: DataFrame, *, intents: int = 3, shortest: int = 3, categories: list[str] | None = None) -> DataFrame:
    """(id, type, query, expected_category, expected_intent): basic, boundary and follow-up cases.

    ``categories`` names those with follow-ups; without it every category of two intents or more has one.
    """
    good = qa.dropna(subset=["instruction", "response"]).where(F.trim("instruction") != "")
    firsts = good.groupBy("category", "intent").agg(F.min_by(F.struct("instruction", "pos"), "pos").alias("f")).select("category", "intent", "f.instruction", "f.pos")
    by_name = Window.partitionBy("category").orderBy("intent")
    basic = firsts.withColumn("_n", F.row_number().over(by_name)).where(F.col("_n") <= intents)
    case = lambda df, kind, name: df.select(name.alias("id"), F.lit(kind).alias("type"), F.col("instruction").alias("query"), F.col("category").alias("expected_category"), F.col("intent").alias("expected_intent"))
    short = good.orderBy(F.length("instruction"), "pos").limit(shortest)
    by_place = Window.partitionBy("category").orderBy("pos")
    followed = firsts if categories is None else firsts.where(F.col("category").isin(categories))
    second = followed.withColumn("_n", F.row_number().over(by_place)).where("_n = 2")
    return (
        case(basic, "basic", F.concat_ws("_", F.lit("basic"), "category", "intent"))
        .unionByName(case(short, "boundary", F.concat_ws("_", F.lit("boundary_short"), "category", "intent")))
        .unionByName(case(second, "multiturn", F.concat_ws("_", F.lit("multiturn"), "category")))
    )


#: Categories that get follow-up cases in the sampled and in the full set.
FOLLOW_UPS = ["ORDER", "REFUND", "DELIVERY", "PAYMENT", "ACCOUNT"]
FOLLOW_UPS_FULL = [*FOLLOW_UPS, "SHIPPING", "INVOICE", "CANCEL", "FEEDBACK", "CONTACT", "SUBSCRIPTION"]


def evaluation_cases_full(qa: DataFrame, *, categories: list[str] | None = None, least: int = 3, short: int = 10, long: int = 80, most: int = 20) -> DataFrame:
    """(id, type, query, expected_category, expected_intent): every distinct question, the first short and long ones, follow-ups.

    Numbers in ids are positions, so that they need no running count. ``categories`` names
    those with follow-ups; without it every category of two intents or more has one.
    """
    rows = qa.select("pos", "category", "intent", "instruction", F.trim("instruction").alias("q"))
    good = rows.where(F.length("q") >= least)
    first = good.groupBy(F.lower("q").alias("_k")).agg(F.min("pos").alias("pos"))
    basic = good.join(first.select("pos"), "pos", "left_semi")

    def edge(keep: Column) -> DataFrame:
        once = rows.where(keep).groupBy("instruction").agg(F.min("pos").alias("pos"))
        return rows.join(once.select("pos").orderBy("pos").limit(most), "pos", "left_semi").where("q <> ''")

    by_intent = rows.groupBy("category", "intent").agg(F.min_by(F.struct("instruction", "pos"), "pos").alias("f")).select("category", "intent", F.col("f.instruction").alias("q"), F.col("f.pos").alias("pos"))
    if categories is not None:
        by_intent = by_intent.where(F.col("category").isin(categories))
    second = by_intent.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("pos"))).where("_n = 2")
    case = lambda df, kind, *name: df.select(F.concat_ws("_", *name).alias("id"), F.lit(kind).alias("type"), F.col("q").alias("query"), F.col("category").alias("expected_category"), F.col("intent").alias("expected_intent"))
    number = F.lpad(F.col("pos").cast("string"), 5, "0")
    return (
        case(basic, "basic", F.lit("basic"), number, "category", "intent")
        .unionByName(case(edge(F.length("instruction") <= short), "boundary", F.lit("boundary_short"), "category", "intent", number))
        .unionByName(case(edge(F.length("instruction") >= long), "boundary", F.lit("boundary_long"), "category", "intent", number))
        .unionByName(case(second, "multiturn", F.lit("multiturn"), "category"))
    )


def hard_negatives(positives: DataFrame, pool: DataFrame, shown: DataFrame, n: int = 2) -> DataFrame:
    """(query_id, chunk_id): the first ``n`` blocks of the positive's page that were not shown for the query.

    A query's blocks are among the first ``n`` + (blocks of the page shown for it) of its
    page, so that many ranks of the page meet it, not the whole page.
    """
    ranked = pool.select("page_name", "chunk_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("page_name").orderBy("chunk_id")))
    pages = positives.select("query_id", "page_name").distinct()
    own = shown.select("query_id", "chunk_id").distinct()
    counts = own.groupBy("query_id").agg(F.count("*").alias("c"))
    wanted = pages.join(counts, "query_id", "left").select("query_id", "page_name", F.explode(F.sequence(F.lit(1), (F.coalesce("c", F.lit(0)) + n).cast("int"))).alias("place"))
    free = wanted.join(ranked, ["page_name", "place"]).join(own, ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    return free.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("query_id", "chunk_id")


def on_ring(c: Column) -> Column:
    """A place from 0 to 2**32 - 1, by the md5 of the text."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def random_negatives(queries: DataFrame, pool: DataFrame, taken: DataFrame, n: int = 2) -> DataFrame:
    """(query_id, chunk_id): for each query the first ``n`` blocks after its own place on a ring of hashes that are not ``taken``.

    The ring is cut into arcs of some 32 blocks. A query meets the arcs next to its place,
    twice as many in each round, until it has ``n`` free blocks or has met the whole ring; so
    it draws from the whole pool, and only queries that need it meet much of it.
    """
    size = pool.count()
    bits = max(0, min(30, (size // 32).bit_length()))
    arcs = 1 << bits
    width = (1 << 32) // arcs
    blocks = pool.select("chunk_id", on_ring(F.col("chunk_id")).alias("at")).withColumn("arc", F.floor(F.col("at") / width).cast("long"))
    left = queries.select("query_id").distinct().withColumn("from", on_ring(F.col("query_id")))
    shown = taken.select("query_id", "chunk_id").distinct()
    done, reach = None, 2
    while True:
        reach = min(reach, arcs)
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reach if reach < arcs else arcs - 1).cast("long"))).alias("step")
        met = left.select("query_id", "from", steps).withColumn("arc", F.pmod(F.floor(F.col("from") / width).cast("long") + F.col("step"), F.lit(arcs)))
        gap = F.pmod(F.col("at") - F.col("from"), F.lit(1 << 32))
        # of the first arc the part before the query's place comes last, and only counts once the whole ring is met
        near = met.join(blocks, "arc").withColumn("gap", gap).where(F.lit(reach >= arcs) | (F.col("step") > 0) | (F.col("at") >= F.col("from")))
        free = near.join(shown, ["query_id", "chunk_id"], "left_anti")
        w = Window.partitionBy("query_id").orderBy("gap", "chunk_id")
        best = free.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("query_id", "chunk_id")
        if reach >= arcs:
            return best if done is None else done.unionByName(best)
        full = best.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= n).select("query_id")
        got = best.join(full, "query_id", "left_semi")
        done = got if done is None else done.unionByName(got)
        left = left.join(full, "query_id", "left_anti")
        if left.isEmpty():
            return done
        reach *= 4


def split_by_hash(df: DataFrame, key: str, percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """(train, validation): a row's side is fixed by the hash of its key."""
    held = on_ring(F.col(key)) % 100 < percent
    return df.where(~held), df.where(held)
