"""Rows chosen in order: as far as a budget goes, or so many of each stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix(df: DataFrame, keys: list[str], cost: str, budget: float, order: list[Column]) -> DataFrame:
    """The first rows of each of ``keys`` by ``order`` whose costs together stay within ``budget``; the first that breaks it ends the choice. A null cost is none."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("__spent", F.coalesce(F.sum(cost).over(so_far), F.lit(0)))
    return rows.where(F.col("__spent") <= budget).drop("__spent")


def stratified(df: DataFrame, strata: list[str], id_col: str, least: int, out: str) -> DataFrame:
    """Up to ``least`` rows of each stratum, with ``out`` their turn from 1, in the order of the md5 of their id, so that any run draws the same. Only the candidates among each task's own rows meet."""
    mark = F.md5(F.col(id_col).cast("string").cast("binary"))
    w = W.partitionBy(*strata).orderBy(mark, id_col)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= least)
