"""Directed graphs as tables of edges (src, dst): roots, closures by depth, firing rules, inversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, depth: int | None = None, upstream: bool = False) -> DataFrame:
    """``origin``, ``node`` and the least ``depth`` of every node within ``depth`` steps (None: any number) of the nodes of ``start``.

    Each step joins the front with the edges and keeps what is new to its origin, so that cycles end. A front is written to the shared folder before the next step, so a plan has one join of the front whatever the depth, a lost executor costs one step, and the walk ends when a front is empty. Null nodes have no way.
    """
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("to")) if upstream else edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    front = write_table(start.where("node is not null").select(F.col("node").alias("origin"), "node").distinct(), "front")
    seen, levels, at = front, [], 0
    while depth is None or at < depth:
        at += 1
        new = front.join(step.where("to is not null"), "node").select("origin", F.col("to").alias("node")).distinct()
        front = write_table(new.join(seen, ["origin", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        levels.append(front.withColumn("depth", F.lit(at)))
        seen = seen.unionByName(front)
    none = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, levels, none)


def strong_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that lies on a cycle with another.

    In rounds: each node takes, in turns, the smallest node that reaches it and the smallest that it reaches, within its part; parts are split by both until nothing changes, so that nodes of one component always agree. Edges between parts can lie on no cycle and leave with every round.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).where("node is not null").distinct()
    live = write_table(edges.where("src <> dst and src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    parts = write_table(nodes.select("node", F.lit(0).cast("bigint").alias("part")), "parts")
    count = -1
    while True:
        up, down = _least_over(live, nodes, False), _least_over(live, nodes, True)
        marked = parts.join(up.withColumnRenamed("least", "__up"), "node").join(down.withColumnRenamed("least", "__down"), "node")
        parts = write_table(marked.select("node", F.xxhash64("part", "__up", "__down").alias("part")), "parts")
        now = parts.select("part").distinct().count()
        if now == count:
            break
        count = now
        of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"__{c}"))
        live = write_table(live.join(of("src"), "src").join(of("dst"), "dst").where("__src = __dst").select("src", "dst"), "edges")
    on = live.select(F.col("src").alias("node")).distinct().join(parts, "node")
    return on.join(on.groupBy("part").agg(F.min("node").alias("component")), "part").select("node", "component")


def _least_over(edges: DataFrame, nodes: DataFrame, back: bool) -> DataFrame:
    """``node`` and ``least``: the smallest node from which (``back``: to which) it can be reached, itself included. Each round a node takes what its neighbours have, and what the node that it has taken has, so that ways double."""
    a, b = ("dst", "src") if back else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    least = write_table(nodes.select("node", F.col("node").alias("least")), "least")
    while True:
        near = least.join(step, "node").select(F.col("to").alias("node"), "least")
        far = least.select("node", F.col("least").alias("__at")).join(least.select(F.col("node").alias("__at"), "least"), "__at").select("node", "least")
        after = write_table(least.unionByName(near).unionByName(far).groupBy("node").agg(F.min("least").alias("least")), "least")
        if after.exceptAll(least).isEmpty():
            return after
        least = after


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of strong components, and those with an edge to themselves."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    return strong_components(edges).select("node").unionByName(loops).distinct()


def without_back_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """``edges`` without those that keep it from being acyclic: edges to the own node, and in each strong component those that lead to a node that comes no later by ``order`` (a column of the edges' own rank of ``dst`` less that of ``src``; None: by the nodes themselves). Edges between components stay, whatever their order."""
    of = lambda c: strong.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
    strong = write_table(strong_components(edges), "strong")
    marked = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    inside = F.coalesce(F.col("__src") == F.col("__dst"), F.lit(False))
    back = F.col(order) <= 0 if order else F.col("dst") <= F.col("src")
    return marked.where(~(inside & back) & ~F.coalesce(F.col("src") == F.col("dst"), F.lit(False))).select(*edges.columns)


def inverted(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """For each target, after its name is resolved by ``alias`` (name, node), the edges that lead to it; of several sources of one kind the first in order."""
    named = edges.join(alias.withColumnsRenamed({"name": "dst", "node": "__to"}), "dst", "left").withColumn("node", F.coalesce("__to", "dst"))
    return named.groupBy("node", "kind").agg(F.min("src").alias("source"), F.count(F.lit(1)).alias("n_edges"))


def fires(active: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule, driver, needed) whose active drivers of ``active`` (entity, driver) are ``needed`` or more; needed null: all of them. Gives entity, rule, n_active, n_drivers and share."""
    size = rules.groupBy("rule").agg(F.count_distinct("driver").alias("n_drivers"), F.max("needed").alias("needed"))
    hits = active.select("entity", "driver").distinct().join(rules.select("rule", "driver").distinct(), "driver").groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("n_active"))
    fired = hits.join(size, "rule").where(F.col("n_active") >= F.coalesce("needed", "n_drivers"))
    return fired.select("entity", "rule", "n_active", "n_drivers", (F.col("n_active") / F.col("n_drivers")).alias("share"))


def edge_rows(parents: DataFrame, node: str, parent_array: str, kind: Column) -> DataFrame:
    """Edge rows from a table of nodes with an array of their parents."""
    return parents.select(F.explode(parent_array).alias("src"), F.col(node).alias("dst"), kind.alias("kind"))
