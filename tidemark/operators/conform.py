"""From raw to conformed rows: types, sentinels, units, reshaping, duplicates and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in float columns, as missing is null in all operators."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def scrub(df: DataFrame, column: str, sentinels: list) -> DataFrame:
    """Stand-ins for missing values become null."""
    return df.withColumn(column, F.when(~F.col(column).isin(*sentinels), F.col(column)))


def coerce(df: DataFrame, kinds: dict[str, str], strict: bool = False) -> DataFrame:
    """Casts by column; what doesn't parse gives null, or an error if ``strict``."""
    return df.withColumns({c: F.col(c).cast(kind) if strict else F.col(c).try_cast(kind) for c, kind in kinds.items()})


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row for each key and column whose value isn't null."""
    return df.select(*keys, *(F.col(c).cast("double") for c in columns)).unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def widen(df: DataFrame, keys: list[str], name: str, value: str, columns: list) -> DataFrame:
    """One column for each of ``columns``; of several values the smallest, so that the result depends on no order."""
    return df.groupBy(*keys).pivot(name, columns).agg(F.min(value))


def convert_units(df: DataFrame, unit: str, value: str, factors: dict[str, float], out: str, strict: bool = False) -> DataFrame:
    """``value`` times the factor of its unit; an unknown unit gives null, or an error if ``strict``."""
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    factor = F.try_element_at(table, F.col(unit))
    if strict:
        factor = F.coalesce(factor, F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(F.col(unit), F.lit("null")))).cast("double"))
    return df.withColumn(out, F.col(value) * factor)


def dedup_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which should tell all its rows apart."""
    w = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collapse(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key: ``n_rows``, ``n_versions`` of its values (nulls count as a version) and the smallest version."""
    version = F.struct(*values)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.to_json(version, {"ignoreNullFields": "false"})).alias("n_versions"), F.min(version).alias("v")).select(*keys, "n_rows", "n_versions", "v.*")


def collapse_or_fail(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key; two versions of a key are an error."""
    told = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    return collapse(df, keys, values).withColumn("__ok", F.assert_true(F.col("n_versions") == 1, F.concat(F.lit("conflicting rows for "), told))).where(F.col("__ok").isNull()).select(*keys, *values)


def prefer(df: DataFrame, keys: list[str], column: str, ranking: list, tiebreak: list[str]) -> DataFrame:
    """The row of each key whose ``column`` comes first in ``ranking``; others come after all of it."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranking)), F.col(column)), F.lit(0))
    rank = F.when(rank == 0, len(ranking) + 1).otherwise(rank)
    w = W.partitionBy(*keys).orderBy(rank, *tiebreak)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def admit(df: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(registry, keys, "left_semi")


def decline(df: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(registry, keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, within: float) -> DataFrame:
    """Each key's status: matched, mismatch, left_only or right_only. Keys whose value is null on a side count as absent there."""
    a = left.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("left_value"))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("right_value"))
    status = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(F.abs(F.col("left_value") - F.col("right_value")) <= within, "matched").otherwise("mismatch")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def band(value: Column, rungs: list[tuple[float, str]], otherwise: str | None = None) -> Column:
    """The label of the highest rung that ``value`` reaches; null stays null."""
    label = F.lit(otherwise)
    for at, name in sorted(rungs):
        label = F.when(value >= at, name).otherwise(label)
    return F.when(value.isNotNull(), label)


def snake_case(name: Column) -> Column:
    """A key from a name: accents off, lower case, runs of other characters one underscore."""
    folded = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_number(raw: Column) -> Column:
    """Numbers as people write them: 1.782,18 and 1,782.18, spaces, footnote marks and brackets for negatives; null if none."""
    plain = F.regexp_replace(raw, r"[\s*†‡]|\([a-z0-9]\)$", "")
    negative = plain.rlike(r"^\(.*\)$|^-")
    plain = F.regexp_replace(plain, r"[()\-+]", "")
    comma = plain.rlike(r",\d{1,2}$|^\d{1,3}(\.\d{3})+$") & ~plain.rlike(r"^\d{1,3}\.\d{3}$")
    value = F.when(comma, F.translate(F.translate(plain, ".", ""), ",", ".")).otherwise(F.translate(plain, ",", "")).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def group_digest(df: DataFrame, keys: list[str], columns: list[str], out: str = "digest") -> DataFrame:
    """For each of ``keys``, ``n_rows`` and a digest of what its rows hold in ``columns``, whatever their order: counts, sums and exclusive-ors of two hashes of a row, so that repeated rows count and every task sums up its own. Nulls differ from empty texts."""
    parts = [F.concat(F.col(c).isNull().cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    row = F.concat_ws("\x1f", *(F.concat(F.length(p).cast("string"), F.lit("#"), p) for p in parts))
    high, low = (F.conv(F.substring(F.md5(row.cast("binary")), at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(high).alias("__a"), F.sum(low).alias("__b"))
    return total.select(*keys, "n_rows", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("__a").cast("string"), F.col("__b").cast("string")).cast("binary")).alias(out))
