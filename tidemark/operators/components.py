"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table

#: Rounds before giving up; the number needed grows with the logarithm of the longest chain.
MOST_ROUNDS = 60


def dealt(side: DataFrame) -> DataFrame:
    """``side`` of a join that is dealt by its keys, never sent to every executor by way of the driver. Spark tells a table's size by its files, before it explodes or gathers rows: it would broadcast sides of millions of rows."""
    return side.hint("merge")


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step. Edges (node, to) have to < node.

    both_ways (large star): each larger neighbour of a node is linked to the smallest of its neighbourhood. Else (small star): the node and its smaller neighbours are linked to the smallest of them.
    """
    if both_ways:
        sides = edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = sides.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
        up = edges.select(F.col("to").alias("node"), F.col("node").alias("other"))
        return up.join(dealt(least), "node").select(F.col("other").alias("node"), F.col("least").alias("to")).where("to < node").distinct()
    least = edges.groupBy("node").agg(F.min("to").alias("least"))
    moved = edges.join(dealt(least), "node").where("to > least").select(F.col("to").alias("node"), F.col("least").alias("to"))
    return moved.unionByName(least.select("node", F.col("least").alias("to"))).distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b) that isn't the smallest of its component; root is the smallest.

    Self links and repeated links do no harm. Each round is written to the shared folder, so that lineage stays short and a lost executor costs one round. The rounds end when every node has one link, to a node that has none.
    """
    start = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct()
    edges = write_table(start, "edges")
    for _ in range(MOST_ROUNDS):
        ends = edges.select(F.inline(F.array(F.struct(F.col("node").alias("end"), F.lit(1).alias("up")), F.struct(F.col("to").alias("end"), F.lit(0).alias("up")))))
        open_ends = ends.groupBy("end").agg(F.sum("up").alias("links"), F.min("up").alias("own")).where("links > 1 or links = 1 and own = 0")
        if not open_ends.agg(F.count(F.lit(1))).first()[0]:
            return edges.select("node", F.col("to").alias("root"))
        after = write_table(_star(_star(edges, True), False), "edges")
        drop_table(edges)
        edges = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
