"""Statistics of a table's files that are kept and merged, so that only new files are read, and gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that stand for a missing one.
SENTINELS = (-999.0, -99.9, -9999.0)
#: A value this near to a sentinel is one.
NEAR = 1e-9

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _state(df: DataFrame, name: str) -> Column:
    """What one part tells of a column. NaN is no value; numbers have their ends as doubles, all other types as text."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    value = F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c
    number = isinstance(kind, _NUMBERS)
    ends = lambda f: (f(value.cast("double")) if number else F.lit(None).cast("double"), F.lit(None).cast("string") if number else f(value.cast("string")))
    (low, low_text), (high, high_text) = ends(F.min), ends(F.max)
    return F.struct(F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_present"), F.count(value).alias("n_values"), low.alias("low"), high.alias("high"), low_text.alias("low_text"), high_text.alias("high_text"))


def partials(df: DataFrame, parts: list[str], columns: list[str]) -> DataFrame:
    """A row for each part and each of ``columns`` that ``df`` has: ``n_rows``, ``n_present`` (not null), ``n_values`` (nor NaN) and the ends of the values. One pass, combined before the shuffle."""
    held = [c for c in columns if c in df.columns]
    if not held:
        raise ValueError("none of the columns is in the table")
    return df.groupBy(*parts).agg(F.array(*(_state(df, c) for c in held)).alias("__x")).select(*parts, F.inline("__x"))


def refresh(spark: SparkSession, path: str, kept: DataFrame | None, columns: list[str], pattern: str = "*.parquet") -> DataFrame:
    """``partials`` of the Parquet files below ``path`` by ``file``, ``written`` and ``length``: those of ``kept`` that still hold, and new ones of files that it lacks or has with another time or length.

    Only such files are read. A file that is gone takes its statistics with it. The driver holds the names of the files to be read, as a scan of them does anyway; no data.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stamp = ["file", "written", "length"]
    files = listed.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_size").alias("length"))
    stale = files if kept is None else files.join(kept.select(*stamp).distinct(), stamp, "left_anti")
    names = [r.path for r in stale.select("path").collect()]
    still = None if kept is None else kept.join(files.select(*stamp), stamp, "left_semi")
    if not names:
        return still if still is not None else spark.createDataFrame([], "file string, written timestamp, length bigint, column string, n_rows bigint, n_present bigint, n_values bigint, low double, high double, low_text string, high_text string")
    df = spark.read.option("mergeSchema", "true").parquet(*names)
    marked = df.withColumns({"file": F.col("_metadata.file_path"), "written": F.col("_metadata.file_modification_time"), "length": F.col("_metadata.file_size")})
    new = partials(marked, stamp, columns)
    return new if still is None else still.select(*new.columns).unionByName(new)


def merged(states: DataFrame, sentinels: tuple[float, ...] = SENTINELS) -> DataFrame:
    """One row for each column of ``partials``, whatever its parts were: ``n_parts``, ``n_rows``, ``n_values``, ``share`` of values (no rows: 0), the ends, ``distinct_at_least`` (0: no value, 1: one, 2: two or more), ``all_missing`` (rows, but no value), ``constant``, and ``saturated`` (constant at a sentinel)."""
    sums = states.groupBy("column").agg(F.count(F.lit(1)).alias("n_parts"), *(F.sum(c).alias(c) for c in ("n_rows", "n_values")), *(f(c).alias(c) for f, ends in ((F.min, ("low", "low_text")), (F.max, ("high", "high_text"))) for c in ends))
    one = F.when(F.col("low").isNotNull(), F.col("low") == F.col("high")).otherwise(F.col("low_text") == F.col("high_text"))
    sums = sums.withColumn("share", F.coalesce(F.try_divide(F.col("n_values").cast("double"), F.col("n_rows")), F.lit(0.0)))
    sums = sums.withColumn("distinct_at_least", F.when(F.col("n_values") == 0, 0).when(one, 1).otherwise(2))
    at_sentinel = F.exists(F.array(*(F.lit(float(s)) for s in sentinels)), lambda s: F.abs(F.col("low") - s) < NEAR) if sentinels else F.lit(False)
    return sums.withColumns({"all_missing": (F.col("n_rows") > 0) & (F.col("n_values") == 0), "constant": F.col("distinct_at_least") == 1}).withColumn("saturated", F.col("constant") & F.coalesce(at_sentinel, F.lit(False)))


def floors_at(floors: DataFrame, month: int | None = None) -> DataFrame:
    """The least share of values that each ``column`` must have in ``month``.

    ``floors`` has ``column``, ``floor``, ``first_month``, ``last_month``: null months hold all year; a first month after the last one goes over the turn of the year. Of the seasons that hold the highest counts, before what holds all year; without a month no season does.
    """
    first, last, at = F.col("first_month"), F.col("last_month"), F.lit(month).cast("int")
    inside = F.when(first <= last, at.between(first, last)).otherwise((at >= first) | (at <= last))
    season = F.max(F.when(first.isNotNull() & last.isNotNull() & inside, F.col("floor")))
    always = F.max(F.when(first.isNull() | last.isNull(), F.col("floor")))
    return floors.groupBy("column").agg(F.coalesce(season, always).alias("floor")).where("floor is not null")


def gate(census: DataFrame, floors: DataFrame, known_at: str | None = None) -> DataFrame:
    """What forbids a table, of ``merged`` and ``floors_at``: a row for each ``column`` and ``kind``, with the ``observed`` and the ``threshold`` share.

    ``all_missing``; else ``below_floor`` and ``saturated`` or ``constant``, for the columns that have a floor. ``single_vintage`` where the column ``known_at`` has one value only. A column with a floor that the census lacks is ``absent``.
    """
    held = floors.join(census, "column", "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n_rows").isNull(), F.lit("absent")),
            F.when(F.col("all_missing"), F.lit("all_missing")),
            F.when(~F.col("all_missing") & (F.col("share") < F.col("floor")), F.lit("below_floor")),
            F.when(F.col("saturated"), F.lit("saturated")).when(F.col("constant"), F.lit("constant")),
        )
    )
    found = held.select("column", F.explode(kinds).alias("kind"), F.col("share").alias("observed"), F.col("floor").alias("threshold"))
    if known_at is None:
        return found
    none = F.lit(None).cast("double")
    return found.unionByName(census.where((F.col("column") == known_at) & F.col("constant")).select("column", F.lit("single_vintage").alias("kind"), none.alias("observed"), none.alias("threshold")))


def diverging(sample: DataFrame, full: DataFrame, floors: DataFrame) -> DataFrame:
    """Columns for which a sample of the files and all of them stand on different sides of the floor: ``column``, both shares, ``floor``. Such a sample speaks for no one."""
    shares = lambda df, name: df.select("column", F.col("share").alias(name))
    both = shares(sample, "sample_share").join(shares(full, "full_share"), "column").join(floors, "column")
    return both.where((F.col("sample_share") < F.col("floor")) != (F.col("full_share") < F.col("floor"))).select("column", "sample_share", "full_share", "floor")
