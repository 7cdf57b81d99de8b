"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import drop_folder, stored


#: Nodes whose labels may be broadcast; 16 bytes each.
BROADCAST_NODES = 1_000_000


def _facts(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """node and label, its component's least node, for every node of ``edges`` (a, b; long).

    Each round ties every node's larger neighbours to the least one (large star), then its smaller neighbours and
    itself (small star); the edges become one star for each component after a number of rounds that grows with the
    logarithm of its size. Rounds are written to the shared folder, and nothing but two numbers goes to the driver.

    A hub's edges need not meet in one task: least neighbours are aggregated before they are shuffled, and edges get
    them by a broadcast if that is known to be small, else from a stored table, a join whose skew Spark splits.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _facts(now)

    def tied(rows: DataFrame, least: DataFrame) -> DataFrame:
        if 2 * before[0] <= BROADCAST_NODES:
            return rows.join(F.broadcast(least), "u")
        return rows.join(stored(least, "edges-least"), "u")

    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(tied(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = tied(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_folder(now, large)
        now, after = new, _facts(new)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
