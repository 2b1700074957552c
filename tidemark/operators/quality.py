"""Contracts, one-pass quality reports and censuses."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """What a table must be: columns with their types, keys, which may not be null, ranges."""

    columns: dict[str, str]
    keys: tuple[str, ...]
    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T._parse_datatype_string(kind), c not in self.required) for c, kind in self.columns.items()])

    def ddl(self, table: str, path: str, partitions: tuple[str, ...] = ()) -> str:
        body = ",\n  ".join(f"`{c}` {kind}" for c, kind in self.columns.items() if c not in partitions)
        parts = f"\nPARTITIONED BY ({', '.join(f'`{c}` {self.columns[c]}' for c in partitions)})" if partitions else ""
        return f"CREATE EXTERNAL TABLE {table} (\n  {body}\n){parts}\nSTORED AS PARQUET\nLOCATION '{path}'"

    def may_become(self, other: Contract) -> list[str]:
        """What forbids the change: only new columns at the end that may be null, and wider numbers, are allowed."""
        wider = {("int", "bigint"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint")}
        names, others = list(self.columns), list(other.columns)
        found = [f"dropped or moved: {c}" for i, c in enumerate(names) if i >= len(others) or others[i] != c]
        found += [f"narrowed: {c}" for c in names if c in other.columns and self.columns[c] != other.columns[c] and (self.columns[c], other.columns[c]) not in wider]
        return found + [f"new but required: {c}" for c in others if c not in self.columns and c in other.required]

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` in the contract's order and types; what can't be cast, or a missing column, is an error."""
        return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in self.columns.items()))


def report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row for each check of ``contract``, with how many rows break it, in one pass over the rows and one over the keys."""
    checks: dict[str, Column] = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in (*contract.keys, *contract.required)}
    for c, (low, high) in contract.ranges.items():
        outside = F.lit(False)
        outside = outside | (F.col(c) < low) if low is not None else outside
        outside = outside | (F.col(c) > high) if high is not None else outside
        checks[f"range:{c}"] = F.count_if(outside)
    row = df.agg(*(x.alias(name) for name, x in checks.items()), F.count(F.lit(1)).alias("rows"))
    repeated = df.groupBy(*contract.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_keys").alias("check"), F.col("n").alias("n_rows"))
    return row.unpivot([], [*checks, "rows"], "check", "n_rows").unionByName(repeated)


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, values that aren't null, the smallest and largest as strings, and whether it has but one value."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"), (F.min(c) == F.max(c)).alias("constant")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def missing_rates(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Share of nulls of each column in each group, one pass."""
    rates = df.groupBy(*group).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return rates.unpivot(group, columns, "column", "null_rate")


def complete_months(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Months of each key in which every day of the calendar has a row."""
    day = F.to_date(at)
    months = df.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(F.count_distinct(day).alias("n_days"))
    return months.where(F.col("n_days") == F.dayofmonth(F.last_day("month")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
