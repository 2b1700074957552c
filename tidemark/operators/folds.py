"""Validation by groups: folds that no group straddles, collapse of a group's predictions, permuted targets, greedy choices under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of more than 1 / LARGE of a fold's fair share are placed one by one; there are at most LARGE groups a fold of them.
LARGE = 1000
#: Parts in which a key's rows are ranked.
PARTS = 256


def grouped_folds(df: DataFrame, groups: list[str], folds: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` (from 0), the same for all rows of a group. Large groups go, the largest first, to the fold with the fewest rows; the many small ones by a hash of the group, to each fold in proportion to what it lacks. Null group columns form groups too."""
    if folds < 2:
        raise ValueError("at least two folds")
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    least = max(1, total // (folds * LARGE))
    large = sizes.where(F.col("__n") > least).orderBy(F.col("__n").desc(), *groups).collect()
    held, rows = [0] * folds, []
    for r in large:
        k = held.index(min(held))
        held[k] += r["__n"]
        rows.append((*(r[g] for g in groups), k))
    lacks = [max(0.0, total / folds - n) for n in held]
    steps = [sum(lacks[: k + 1]) / sum(lacks) if sum(lacks) else (k + 1) / folds for k in range(folds - 1)]
    drawn = F.pmod(F.xxhash64(F.lit(seed), *groups), F.lit(1 << 30)) / (1 << 30)
    hashed = sum(((drawn >= s).cast("int") for s in steps), F.lit(0))
    if not rows:
        return df.withColumn("fold", hashed)
    placed = df.sparkSession.createDataFrame(rows, T.StructType([*(T.StructField(f"__{g}", df.schema[g].dataType) for g in groups), T.StructField("__fold", T.IntegerType())]))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return df.join(F.broadcast(placed), on, "left").withColumn("fold", F.coalesce("__fold", hashed)).select(*df.columns, "fold")


def grouped_walk_forward(df: DataFrame, groups: list[str], period: str, least: int, train_from: int | None = None) -> DataFrame:
    """For each period with ``least`` periods before it (from ``train_from`` on): ``fold`` (the period), ``train_periods``, ``train_rows``, ``test_rows``, ``test_groups`` and ``straddling``, the test groups that have rows to train on too, which must be 0. Rows without a period are left out; periods are few, so their table is ordered in one task."""
    rows = df.where(F.col(period).isNotNull())
    per = rows.groupBy(F.col(period).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows"), F.count_distinct(F.struct(*groups)).alias("test_groups"))
    first = rows.where(F.col(period) >= train_from) if train_from is not None else rows
    spans = first.groupBy(*groups).agg(F.min(period).alias("__lo"))
    old = rows.join(spans, groups).where(F.col("__lo") < F.col(period)).groupBy(F.col(period).alias("fold")).agg(F.count_distinct(F.struct(*groups)).alias("straddling"))
    counts = F.when(F.col("fold") >= train_from, F.col("test_rows")) if train_from is not None else F.col("test_rows")
    before = W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    told = per.select("fold", F.count(counts).over(before).alias("train_periods"), F.coalesce(F.sum(counts).over(before), F.lit(0)).alias("train_rows"), "test_rows", "test_groups")
    return told.where(F.col("train_periods") >= least).join(old, "fold", "left").withColumn("straddling", F.coalesce("straddling", F.lit(0)))


def collapse(df: DataFrame, groups: list[str], at: str, predicted: str, policy: str, weight: str | None = None) -> DataFrame:
    """One row for each group: its newest row, with ``predicted`` the newest ("latest"), the mean ("mean") or the mean by ``weight`` ("weighted_mean"; a null weight counts as 0, and if the weights' sum isn't positive the plain mean is taken). Of rows of one time that of the largest values wins."""
    if policy not in ("latest", "mean", "weighted_mean"):
        raise ValueError(policy)
    newest = F.max_by(F.struct(*df.columns), F.struct(at, *(c for c in df.columns if c != at))).alias("__row")
    mean = F.avg(predicted)
    if policy == "weighted_mean":
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
        both = F.sum(F.when(F.col(predicted).isNotNull(), F.col(predicted) * w))
        mean = F.when(F.sum(w) > 0, both / F.sum(w)).otherwise(mean)
    rows = df.groupBy(*groups).agg(newest, mean.alias("__mean")).select("__row.*", "__mean")
    return rows.drop("__mean") if policy == "latest" else rows.withColumn(predicted, F.col("__mean")).drop("__mean")


def _ranked(df: DataFrame, keys: list[str], number: str, out: str, parts: int = PARTS) -> DataFrame:
    """``df`` with ``out``, the rank of its row (from 0) by ``number`` (an even hash, distinct in a key) among those of its keys: ranks in parts by the hash's range, and the counts of the parts before. No task holds a key's rows."""
    part = F.shiftrightunsigned(F.col(number), 56).bitwiseXOR(F.lit(128)).cast("int")
    marked = df.withColumn("__part", part)
    counts = marked.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = marked.withColumn("__at", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(number)) - 1)
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(before, on).withColumn(out, F.col("__before") + F.col("__at")).select(*df.columns, out)


def permuted(df: DataFrame, keys: list[str], column: str, id_col: str, seed: int, out: str | None = None) -> DataFrame:
    """``df`` with the values of ``column`` dealt anew among the rows of the same ``keys``, in ``out`` (None: in their place): each row takes the value of the row whose place by one keyed hash of ``id_col`` is its own place by another. The same seed gives the same permutation on any partitioning. Ids must be distinct within the keys; nulls among the values are dealt like others."""
    h = lambda salt: F.xxhash64(F.lit(salt), F.lit(seed), F.col(id_col))
    takes = _ranked(df.withColumn("__h", h("to")), keys, "__h", "__place").drop("__h")
    gives = _ranked(df.select(*keys, F.col(column).alias("__value"), h("from").alias("__h")), keys, "__h", "__from")
    gives = gives.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__value", "__from")
    on = F.col("__place") == F.col("__from")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = takes.join(gives, on)
    if out is None:
        return joined.select(*(F.col("__value").alias(c) if c == column else F.col(c) for c in df.columns))
    return joined.select(*df.columns, F.col("__value").alias(out))


def greedy_budget(df: DataFrame, keys: list[str], value: str, cost: str, budget: str, tiebreak: list[str]) -> DataFrame:
    """The rows of each of ``keys`` that are taken, by value over cost from the highest, while the sum of costs stays within the column ``budget`` of the key; one that doesn't fit is passed over and the next is tried. ``spent`` is the sum with the row.

    Rows without cost (null or 0) have a ratio of 0; a null value too; a null budget takes nothing. Ties go by ``tiebreak``. Rows stream through a task in order, so that its memory is one batch, however many rows a key has; those that no budget can pay don't get there.
    """
    ratio = F.coalesce(F.when(F.col(cost) != 0, F.col(value) / F.col(cost)), F.lit(0.0))
    fit = df.where(F.coalesce(F.col(cost), F.lit(0)) <= F.col(budget)).withColumn("__ratio", ratio).withColumn("__key", F.xxhash64(*keys))
    ordered = fit.repartition(*keys).sortWithinPartitions(*keys, F.col("__ratio").desc(), *tiebreak)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("spent", T.DoubleType())])
    at = [ordered.columns.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spent = None, 0.0
        for batch in batches:
            taken, sums = [], []
            columns = [batch.column(k).to_pylist() for k in at]
            costs, most = batch.column(names.index(cost)).to_pylist(), batch.column(names.index(budget)).to_pylist()
            for k, now in enumerate(zip(*columns, strict=True)):
                if now != key:
                    key, spent = now, 0.0
                if spent + (costs[k] or 0.0) <= most[k]:
                    spent += costs[k] or 0.0
                    taken.append(k)
                    sums.append(spent)
            part = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(sums, pa.float64())], names=schema.names)

    return ordered.mapInArrow(run, schema)
