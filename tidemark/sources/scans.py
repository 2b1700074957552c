"""Scans of tables and landed files, with their contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.conform import nan_to_null
from ..operators.quality import Contract


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a Parquet table: only ``columns`` that it has, ``where`` pushed to the scan, and of a table with a column year only ``years`` (partitions are pruned)."""
    df = spark.read.parquet(path)
    if years and "year" in df.columns:
        df = df.where(F.col("year").between(*years))
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*(c for c in columns if c in df.columns))
    return nan_to_null(df)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows of ``schema`` where there is no such path: a missing source is missing data, any other failure shows."""
    try:
        return spark.read.parquet(path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def check_keys(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` in the contract's columns; a row whose key occurs twice, or is null, fails the job that reads it."""
    told = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in contract.keys))
    w = W.partitionBy(*contract.keys)
    ok = (F.count(F.lit(1)).over(w) == 1) & F.forall(F.array(*(F.col(k).isNotNull() for k in contract.keys)), lambda x: x)
    checked = contract.apply(df).withColumn("__ok", F.assert_true(ok, F.concat(F.lit("bad key: "), told)))
    return checked.where(F.col("__ok").isNull()).drop("__ok")


def inventory(spark: SparkSession, path: str, pattern: str = "*", least_bytes: int = 0) -> DataFrame:
    """Files below ``path`` with their time and length, without reading them; shorter ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").where(F.col("length") >= least_bytes)


def to_refresh(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions whose newest source is younger than their target, or that have none."""
    newest = sources.groupBy(*keys).agg(F.max("modificationTime").alias("source_time"))
    built = targets.groupBy(*keys).agg(F.min("modificationTime").alias("target_time"))
    return newest.join(built, keys, "left").where(F.col("target_time").isNull() | (F.col("source_time") > F.col("target_time"))).select(*keys)


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes, str], pd.DataFrame], schema: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Rows that ``parser`` makes of each landed file, with ``source_file``, and the files that it failed on with their errors. A file is parsed by one task, whatever the format."""
    names = T._parse_datatype_string(schema).fieldNames()
    full = f"{schema}, source_file string, parse_error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    made = parser(bytes(content), name)[names].assign(source_file=name, parse_error=None)
                except Exception as error:  # kept as a row of the second table
                    made = pd.DataFrame([{"source_file": name, "parse_error": f"{type(error).__name__}: {error}"}]).reindex(columns=[*names, "source_file", "parse_error"])
                yield made.astype(object).where(made.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parsed = files.select("path", "content").mapInPandas(run, full)
    return parsed.where("parse_error is null").drop("parse_error"), parsed.where("parse_error is not null").select("source_file", "parse_error")
