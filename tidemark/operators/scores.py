"""Scores against a history that is wide enough: fallback over a hierarchy of groups, winsorized z scores, clusters of scores that say the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import smallest_reachable

#: Values from which on a history is winsorized, and its limits.
ROBUST, LIMITS = 20, (0.05, 0.95)


def _quantile(values, q: float):
    """Interpolated, of a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return a + (b - a) * (at - low)


def winsorized_z(value, history, robust: int = ROBUST, limits: tuple[float, float] = LIMITS, clip: float = 8.0):
    """Distance of ``value`` from the mean of an array, in population deviations, the array's values first drawn in to its own quantiles ``limits`` if there are ``robust`` or more; cut at ``clip`` either way; null where there is no spread."""
    ordered = F.sort_array(history)
    bounds = F.struct(*(F.when(F.size(ordered) >= robust, _quantile(ordered, q)).alias(n) for n, q in zip(("low", "high"), limits, strict=True)))
    drawn = lambda b: F.transform(history, lambda x: F.greatest(F.least(x, b["high"]), b["low"]))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))
    spread = lambda v, m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(v), F.lit(0)))
    once = lambda column, f: F.get(F.transform(F.array(column), f), F.lit(0))  # noqa: E731  a name bound to a value
    z = lambda v: once(mean(v), lambda m: once(spread(v, m), lambda s: F.when(s > 1e-12, (value - m) / s)))
    found = once(bounds, lambda b: once(drawn(b), z))
    return once(found, lambda z: F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))))


def fallback_z(df: DataFrame, levels: list[tuple[str, list[str]]], at: str, value: str, least: int, clip: float = 8.0) -> DataFrame:
    """``df`` with ``level``, ``n_prior``, ``z`` and ``share_below``: against the earlier values (days before the row's own, so that rows of one day never count for each other) of the first of ``levels`` (a name and its columns, the finest first) that has ``least`` of them; null ``level`` where none has. Null values and those that aren't numbers count nowhere.

    The counts of all levels come from one window each; a row's history is gathered only for the level that it takes, as the others' frames stay empty.
    """
    known = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = df.withColumn("__v", known).withColumn("__day", F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")))
    earlier = lambda columns: W.partitionBy(*columns).orderBy("__day").rangeBetween(W.unboundedPreceding, -1)
    for k, (_, columns) in enumerate(levels):
        rows = rows.withColumn(f"__n{k}", F.count("__v").over(earlier(columns)))
    level = F.lit(None).cast("string")
    for k in range(len(levels) - 1, -1, -1):
        level = F.when((F.col(f"__n{k}") >= least) & F.col("__day").isNotNull(), levels[k][0]).otherwise(level)
    rows = rows.withColumn("level", level)
    history = F.lit(None).cast("array<double>")
    for name, columns in levels:
        history = F.when(F.col("level") == name, F.collect_list("__v").over(earlier(columns))).otherwise(history)
    rows = rows.withColumn("__h", history)
    below = F.try_divide(F.size(F.filter("__h", lambda x: x <= F.col("__v"))).cast("double"), F.size("__h"))
    told = {"n_prior": F.coalesce(F.nullif(F.size("__h"), F.lit(-1)), F.lit(0)), "z": F.when(F.col("level").isNotNull() & F.col("__v").isNotNull(), winsorized_z(F.col("__v"), F.col("__h"), clip=clip)), "share_below": F.when(F.col("level").isNotNull() & F.col("__v").isNotNull(), below)}
    return rows.withColumns(told).select(*df.columns, "level", *told)


def correlations(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """``a``, ``b``, ``n`` and ``correlation`` of all pairs of ``columns``, over the rows that have both: each task sums up products as matrices, which are added over the tasks. Fewer than ``least`` common rows, or no spread, give null. Sums are taken about each column's mean."""
    about = np.array([x or 0.0 for x in df.agg(*(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for c in columns)).first()], dtype=np.float64)
    many = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, many, many))
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) - about
            there = np.isfinite(rows)
            x, one = np.where(there, rows, 0.0), there.astype(np.float64)
            sums += np.stack([one.T @ one, x.T @ one, (x * x).T @ one, x.T @ x])
        i, j = np.triu_indices(many, 1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, sums[0][i, j], sums[1][i, j], sums[1][j, i], sums[2][i, j], sums[2][j, i], sums[3][i, j])], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    vx, vy, cov = (F.col(p) - F.col(a) * F.col(b) / F.col("n") for p, a, b in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")))
    r = F.when((F.col("n") >= least) & (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy")), cov / F.sqrt(vx * vy))
    names = F.array(*map(F.lit, columns))
    return total.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("n").cast("bigint").alias("n"), F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("correlation"))


def clusters(pairs: DataFrame, least: float) -> DataFrame:
    """``component``, ``cluster`` (its first name), ``size`` and ``strongest`` (the largest absolute correlation of its pairs) of the names that pairs of ``correlations`` of ``least`` or more, either sign, connect."""
    strong = pairs.where(F.abs("correlation") >= least)
    rest = smallest_reachable(strong.select("a", "b"))
    names = strong.select(F.explode(F.array("a", "b")).alias("component")).distinct()
    rooted = names.join(rest.withColumnRenamed("node", "component"), "component", "left").withColumn("cluster", F.coalesce("root", "component")).drop("root")
    of_pair = strong.join(rooted.withColumnRenamed("component", "a"), "a").groupBy("cluster").agg(F.max(F.abs("correlation")).alias("strongest"))
    sizes = rooted.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return rooted.join(sizes, "cluster").join(of_pair, "cluster").select("component", "cluster", "size", "strongest")
