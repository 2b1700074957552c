"""Audits of a matrix before it is learned from: leaks, coverage of features, balance of events on independent groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least shares of values of the buckets of a feature, best first.
BUCKETS = ((0.9, "dense"), (0.6, "usable"), (0.2, "sparse"))


@dataclass(frozen=True)
class Names:
    """Rules on the names of features, as regular expressions: those like a target are forbidden; those of the same period are, unless they match ``lagged``."""

    target: str
    same_period: str | None = None
    lagged: str | None = None


def leaks(matrix: DataFrame, features: list[str], names: Names, known_at: str, as_of: str, blocked: DataFrame | None = None) -> DataFrame:
    """``issue``, ``feature`` (null for rows as such), ``n_rows``: rows that knew later than their own date, features whose names tell a target or a value of the same period, and those that ``blocked`` (``feature``) refuses. What is in order gives no row; a null date is not late.

    The rows are read once; names become a small table beside them.
    """
    spark = matrix.sparkSession
    counts = matrix.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(known_at) > F.col(as_of)).alias("late"))
    late = counts.where("late > 0").select(F.lit("known_later").alias("issue"), F.lit(None).cast("string").alias("feature"), F.col("late").alias("n_rows"))
    named = spark.createDataFrame([(f,) for f in features], "feature string")
    of_period = F.lit(False) if names.same_period is None else F.col("feature").rlike(names.same_period)
    if names.lagged is not None:
        of_period = of_period & ~F.col("feature").rlike(names.lagged)
    kinds = [F.when(F.col("feature").rlike(names.target), F.lit("target_like")), F.when(of_period, F.lit("same_period"))]
    if blocked is not None:
        named = named.join(blocked.select("feature", F.lit(True).alias("__blocked")).distinct(), "feature", "left")
        kinds.append(F.when(F.col("__blocked"), F.lit("blocked")))
    told = named.select(F.explode(F.array_compact(F.array(*kinds))).alias("issue"), "feature")
    return late.unionByName(told.join(F.broadcast(counts.select(F.col("n").alias("n_rows")))))


def coverage(matrix: DataFrame, features: list[str], trainable: str, slices: list[str]) -> DataFrame:
    """One row for each feature: ``n_rows``, ``n_trainable``, share of values over all and over trainable rows, the least share over the groups of each of ``slices`` (``least_<slice>``), ``n_distinct``, share of the commonest value among the values, and a ``bucket``.

    NaN counts as missing, and a feature that the matrix lacks as ``missing``. The cells are counted by (feature, slices, value) before anything else is done, so a value or slice that holds most rows is combined before the shuffle.
    """
    spark = matrix.sparkSession
    held = [f for f in features if f in matrix.columns]
    ready = F.coalesce(F.col(trainable), F.lit(False)).alias("__ready")
    names = ["feature", "n_rows", "n_trainable", "share", "trainable_share", *(f"least_{s}" for s in slices), "n_distinct", "mode_share", "bucket"]
    absent = [f for f in features if f not in matrix.columns]
    size = matrix.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(F.col(trainable), F.lit(False))).alias("n_trainable"))
    lacking = spark.createDataFrame([(f,) for f in absent], "feature string").join(F.broadcast(size)).withColumns({"share": F.lit(0.0), "trainable_share": F.lit(0.0), **{f"least_{s}": F.lit(None).cast("double") for s in slices}, "n_distinct": F.lit(0).cast("bigint"), "mode_share": F.lit(None).cast("double"), "bucket": F.lit("missing")}).select(*names)
    if not held:
        return lacking
    values = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in held]
    long = matrix.select(*slices, ready, *values).unpivot([*slices, "__ready"], held, "feature", "value")
    cells = long.groupBy("feature", *slices, "__ready", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    share = present / F.sum("n")
    ready_n = F.sum(F.when(F.col("__ready"), F.col("n")).otherwise(0))
    ready_present = F.sum(F.when(F.col("__ready") & F.col("value").isNotNull(), F.col("n")).otherwise(0))
    made = cells.groupBy("feature").agg(F.sum("n").alias("n_rows"), ready_n.alias("n_trainable"), share.alias("share"), F.try_divide(ready_present.cast("double"), ready_n).alias("trainable_share"))
    for s in slices:
        made = made.join(cells.groupBy("feature", s).agg(share.alias("share")).groupBy("feature").agg(F.min("share").alias(f"least_{s}")), "feature")
    modes = cells.where("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("mode_share"))
    made = made.join(modes, "feature", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    bucket = F.when(F.col("share") == 0, F.lit("all_missing")).when(F.col("share") < BUCKETS[-1][0], F.lit("ultra_sparse")).when(F.col("n_distinct") <= 1, F.lit("constant"))
    for least, name in BUCKETS:
        bucket = bucket.when(F.col("share") >= least, F.lit(name))
    return made.withColumn("bucket", bucket).select(*names).unionByName(lacking)


def event_balance(rows: DataFrame, target: str, group: list[str], at: str, label: str, value: str, trainable: str, origin: str, stage: str) -> DataFrame:
    """Events and values of each target, counted on independent groups: many snapshots of one outcome tell of it once.

    A group's outcome is that of its last row by ``at`` that has a label, else of its last row; of ties that with the greater label and value. ``n_rows``, ``n_trainable``, ``n_groups``, ``n_trainable_groups``, ``median_snapshots``; mean, population deviation and ends of the values of trainable groups; events and their shares over labelled groups and over labelled rows, with the least share of an origin (groups) and of a stage (rows). Shares of nothing are null. A null target is one of its own; a null trainable is false, NaN no value.
    """
    number = F.col(value).cast("double")
    read = rows.select(F.col(target).alias("target"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col(at).alias("at"), F.col(label).cast("boolean").alias("label"), F.when(~F.isnan(number), number).alias("value"), F.coalesce(F.col(trainable), F.lit(False)).alias("ready"), F.col(origin).alias("origin"), F.col(stage).alias("stage"))
    keys = ["target", *(f"__g{k}" for k in range(len(group)))]
    last = F.max(F.struct(F.col("label").isNotNull().alias("told"), "at", "label", "value", "ready", "origin"))
    groups = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), last.alias("o")).select("target", "n", "o.label", "o.value", "o.ready", "o.origin")
    told, happened = F.col("label").isNotNull(), F.coalesce(F.col("label"), F.lit(False))
    ready_value = F.when(F.col("ready"), F.col("value"))
    share = lambda: F.try_divide(F.count_if(happened).cast("double"), F.count_if(told))
    of_rows = read.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ready").alias("n_trainable"), F.count_if(happened).alias("n_event_rows"), share().alias("event_row_share"))
    of_groups = groups.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if("ready").alias("n_trainable_groups"), F.median("n").alias("median_snapshots"), F.avg(ready_value).alias("mean"), F.stddev_pop(ready_value).alias("deviation"), F.min(ready_value).alias("low"), F.max(ready_value).alias("high"), F.count_if(happened).alias("n_event_groups"), share().alias("event_group_share")
    )

    def least(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.groupBy("target", by).agg(share().alias("share")).groupBy("target").agg(F.min("share").alias(name))

    made = of_rows
    for more in (of_groups, least(groups, "origin", "least_origin_share"), least(read, "stage", "least_stage_share")):
        other = more.withColumnRenamed("target", "__target")
        made = made.join(other, _same("target", "__target")).drop("__target")
    return made


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
