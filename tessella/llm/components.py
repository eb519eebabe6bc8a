"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two joins on the link table alone, so a node with very many links is only
ever a skewed join key, which adaptive execution splits; no group is gathered in a task.
The number of rounds is logarithmic in the length of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessella.llm.common import Workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node's neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _kept(work: Workspace, links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``links`` written, and their number and a sum that tells whether they changed, taken while they are written."""
    seen = Observation()
    out = work.keep(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(work: Workspace, links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of the component.

    ``links`` has two columns of one orderable type. Loops are ignored; no links give no rows.
    A task that runs twice can only make a round look like a change, which costs one more round.
    """
    u, v = links.columns
    now, state = _kept(work, links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "links")
    while state[0]:
        new, next_state = _kept(work, _small_star(_large_star(now)), "round")
        work.drop(now)
        now, before, state = new, state, next_state
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
