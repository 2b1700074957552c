"""Writing tables: contracts kept, partitions whole, and nothing shown before it is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Contract, report


def write_partitions(df: DataFrame, path: str, contract: Contract, partitions: list[str], mode: str = "append") -> None:
    """Write ``df`` under its contract, rows of a partition together in few files; a null partition value fails."""
    rows = contract.apply(df)
    for c in partitions:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in partition column {c}")).cast(contract.columns[c])).otherwise(F.col(c)))
    rows.repartition(*(F.col(c) for c in partitions)).write.mode(mode).partitionBy(*partitions).parquet(path)


def publish(df: DataFrame, path: str, contract: Contract) -> DataFrame:
    """Write beside ``path``, check what was written against the contract, and only then put it in place. Returns the report; a broken contract raises and leaves ``path`` as it was.

    The old table is set aside by a rename before the new one takes its name, and removed at the end, so that a failure between leaves both.
    """
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    contract.apply(df).write.parquet(staged)
    found = report(spark.read.parquet(staged), contract)
    broken = {r["check"]: r["n_rows"] for r in found.collect() if r["check"] != "rows" and r["n_rows"]}
    if broken:
        _delete(spark, staged)
        raise ValueError(f"contract broken: {broken}")
    old = f"{path}.old-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    had = fs.exists(at(path))
    if had:
        fs.rename(at(path), at(old))
    fs.rename(at(staged), at(path))
    if had:
        fs.delete(at(old), True)
    return report(spark.read.parquet(path), contract)


def compact(spark: SparkSession, path: str, to: str, keys: list[str], order: list[Column], partitions: list[str]) -> None:
    """Many small files of a table as few for each partition, the last row of each key kept."""
    from pyspark.sql import Window as W

    rows = spark.read.parquet(path)
    last = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    last.repartition(*(F.col(c) for c in partitions)).write.partitionBy(*partitions).parquet(to)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at(path), True)
