"""Feature families by name, their long spine, wide matrix, catalogue and training windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import union_all

SPINE = ("entity", "period", "feature", "value")


@dataclass(frozen=True)
class Family:
    name: str
    build: Callable[..., DataFrame]
    low: float | None = None
    high: float | None = None
    label: bool = False


class Registry:
    """Families by name; each builds rows of SPINE from the same inputs."""

    def __init__(self) -> None:
        self.families: dict[str, Family] = {}

    def add(self, name: str, **more) -> Callable:
        def put(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.families:
                raise ValueError(f"family {name} twice")
            self.families[name] = Family(name, build, **more)
            return build

        return put

    def spine(self, *inputs, names: list[str] | None = None) -> DataFrame:
        """All rows of the families: values that are null or not a number are absent, values out of a family's range become its nearest bound."""
        frames = []
        for family in (self.families[n] for n in names or self.families):
            rows = family.build(*inputs).select(*SPINE).where(F.col("value").isNotNull() & ~F.isnan("value"))
            # greatest and least pass over a bound that is null
            clipped = F.greatest(F.least("value", F.lit(family.high).cast("double")), F.lit(family.low).cast("double"))
            frames.append(rows.withColumn("value", clipped).withColumn("is_label", F.lit(family.label)))
        return union_all(frames)


def matrix(spine: DataFrame, features: list[str]) -> DataFrame:
    """One row for each entity and period, one column for each of ``features``."""
    return spine.groupBy("entity", "period").pivot("feature", features).agg(F.min("value"))


def catalog(spine: DataFrame) -> DataFrame:
    """For each feature its rows, entities, first and last period, and whether every entity has it (shared), one alone (own) or some (partial)."""
    entities = spine.select("entity").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    per = spine.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity").alias("n_entities"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    scope = F.when(F.col("n_entities") == F.col("n_all"), "shared").when(F.col("n_entities") == 1, "own").otherwise("partial")
    return per.join(F.broadcast(entities)).withColumn("scope", scope).drop("n_all")


def training_windows(matrix_df: DataFrame, tiers: dict[str, list[str]], share: float) -> DataFrame:
    """For each tier of columns the periods' span, and the first period in which ``share`` of its columns are there for half of the rows or more."""
    columns = sorted({c for cols in tiers.values() for c in cols})
    present = matrix_df.groupBy("period").agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(t).alias("tier"), (sum((F.col(c) >= 0.5).cast("double") for c in cols) / len(cols)).alias("present")) for t, cols in tiers.items()))
    rows = present.select("period", F.inline(each))
    return rows.groupBy("tier").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.min(F.when(F.col("present") >= share, F.col("period"))).alias("dense_from"))


def tiers(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """``n_rows`` and ``total`` at every tier of ``levels`` (the widest first), from the single cells up to all rows; a column that a tier sums over is null."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"))


def tail_shares(cells: DataFrame, keys: list[str], value: str, tail: float, least: int) -> DataFrame:
    """For each of ``keys`` with ``least`` cells: ``n_cells``, ``mean`` and the share of cells whose value is ``tail`` or more (``tail_share``). Cells without a value count in none."""
    known = cells.where(F.col(value).isNotNull())
    told = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("mean"), F.avg((F.col(value) >= tail).cast("double")).alias("tail_share"))
    return told.where(F.col("n_cells") >= least)
