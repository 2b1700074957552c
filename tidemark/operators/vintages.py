"""Two clocks: the history of a series as every release of it told it, and series that may be joined because one release told them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Deviations up to this are none: a constant window has no z score.
NO_SPREAD = 1e-9


def validity(df: DataFrame, grain: list[str], known_at: str, value: str) -> DataFrame:
    """``grain``, ``value``, ``valid_from`` and ``valid_to``: each value from the release that told it until the next that tells another one (null: still). Releases that repeat the value before them are merged into it, a null value is told like any other; of several values of one release the largest counts; rows without a release date are left out."""
    told = df.where(F.col(known_at).isNotNull()).groupBy(*grain, F.col(known_at).alias("valid_from")).agg(F.max(value).alias(value))
    order = W.partitionBy(*grain).orderBy("valid_from")
    first = F.row_number().over(order) == 1
    changed = told.withColumn("__new", first | ~F.col(value).eqNullSafe(F.lag(value).over(order))).where("__new").drop("__new")
    return changed.withColumn("valid_to", F.lead("valid_from").over(order)).select(*grain, value, "valid_from", "valid_to")


def as_of(rows: DataFrame, day: Column) -> DataFrame:
    """The rows that were valid on ``day``."""
    return rows.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def released_z(df: DataFrame, keys: list[str], period: str, known_at: str, value: str, window: int, least: int) -> DataFrame:
    """``keys``, ``period``, ``value``, ``n``, ``z``, ``valid_from``, ``valid_to``: what each release says of a period, with the z score of its value among the ``window`` periods up to it (itself included, ``least`` values at least, sample deviation) as that release knew them.

    ``period`` is a whole number, one more for the next period; missing ones shorten the window. A row holds as long as no value of its window is revised, so there are as many rows as changes of windows, not releases times periods: each revision is dealt to the windows that it touches as a change of their count, sum and sum of squares (about the key's mean, so that large levels cost no digits), and running sums by release give every window at every change. A period shows from its own first value on; a value withdrawn (null) shows as null. Values of one key share no task unless they touch one window.
    """
    grain = [*keys, period]
    told = validity(df.withColumn(value, F.col(value).cast("double")), grain, known_at, value)
    about = told.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("__about"))
    told = told.join(about, keys).withColumn("__x", F.col(value) - F.col("__about"))
    before = F.lag("__x").over(W.partitionBy(*grain).orderBy("valid_from"))
    change = told.withColumn("__b", before)
    parts = {"__n": F.col("__x").isNotNull().cast("int") - F.col("__b").isNotNull().cast("int")}
    parts["__s"] = F.coalesce("__x", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))
    parts["__q"] = F.coalesce(F.col("__x") * F.col("__x"), F.lit(0.0)) - F.coalesce(F.col("__b") * F.col("__b"), F.lit(0.0))
    dealt = change.withColumns(parts).withColumn("__ahead", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    own = F.col("__ahead") == 0
    dealt = dealt.select(*keys, (F.col(period) + F.col("__ahead")).alias(period), "valid_from", "__n", "__s", "__q", F.when(own, F.struct("__x", value)).alias("__own"))
    points = dealt.groupBy(*grain, "valid_from").agg(*(F.sum(c).alias(c) for c in parts), F.max("__own").alias("__own"))
    order = W.partitionBy(*grain).orderBy("valid_from")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    running = points.select(*grain, "valid_from", *(F.sum(c).over(so_far).alias(c) for c in parts), F.last("__own", True).over(so_far).alias("__own"), F.lead("valid_from").over(order).alias("valid_to")).where("__own is not null")
    n, mean = F.col("__n"), F.try_divide("__s", "__n")
    spread = F.sqrt(F.try_divide(F.greatest(F.col("__q") - F.col("__n") * mean * mean, F.lit(0.0)), n - 1))
    z = F.when((n >= max(least, 2)) & (spread > NO_SPREAD), (F.col("__own.__x") - mean) / spread)
    return running.select(*grain, F.col(f"__own.`{value}`").alias(value), n.cast("int").alias("n"), z.alias("z"), "valid_from", "valid_to")


def same_vintage(df: DataFrame, keys: list[str], period: str, series: str, names: list[str], known_at: str, value: str, day: Column) -> DataFrame:
    """For each of ``keys`` and ``period`` that all series of ``names`` have: a column for each with its newest value known on ``day``, ``vintage`` (its release, if it is one for all) and ``refused`` (values of different releases, or one that isn't one number: two values of one release); refused rows keep their null ``vintage`` and null values, so that they can be counted."""
    known = df.where((F.col(known_at) <= day) & F.col(series).isin(names))
    each = known.groupBy(*keys, period, series, known_at).agg(F.min(value).alias("__least"), F.max(value).alias("__value"))
    told = F.struct(F.col(known_at).alias("at"), "__value", (F.col("__least") != F.col("__value")).alias("__many"))
    newest = [F.max(F.when(F.col(series) == name, told)).alias(f"__{k}") for k, name in enumerate(names)]
    wide = each.groupBy(*keys, period).agg(*newest)
    first = F.col("__0.at")
    fits, whole = F.lit(True), F.lit(True)
    for k in range(len(names)):
        whole = whole & F.col(f"__{k}").isNotNull()
        fits = fits & (F.col(f"__{k}.at") == first) & ~F.col(f"__{k}.__many") & F.col(f"__{k}.__value").isNotNull()
    rows = wide.where(whole).withColumn("__fits", F.coalesce(fits, F.lit(False)))
    shown = [F.when(F.col("__fits"), F.col(f"__{k}.__value")).alias(name) for k, name in enumerate(names)]
    return rows.select(*keys, period, *shown, F.when(F.col("__fits"), first).alias("vintage"), (~F.col("__fits")).alias("refused"))


def standing(df: DataFrame, keys: list[str], period: str, value: str, recent: int, least_share: float, tail: int) -> DataFrame:
    """For each of ``keys`` the newest ``value`` among its own history: ``latest_period``, ``latest``, ``n``, ``mean``, ``share_below`` (earlier values that are at most the latest) and ``declined``: "no_history", or "gappy" where under ``least_share`` of the ``recent`` newest periods, or not all of the last ``tail``, have a value (then the figures are null). Periods are the rows of ``df``; a null value is a gap."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))), lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    rows = df.groupBy(*keys).agg(listed.alias("__l"))
    known = F.filter("__l", lambda x: x["v"].isNotNull())
    some = lambda n: F.slice("__l", 1, n)
    held = lambda n: F.size(F.filter(some(n), lambda x: x["v"].isNotNull()))
    rows = rows.withColumn("__k", known).withColumn("declined", F.when(F.size("__k") == 0, "no_history").when((held(recent) < least_share * F.size(some(recent))) | (held(tail) < F.size(some(tail))), "gappy"))
    ok = F.col("declined").isNull()
    now, prior = F.get("__k", F.lit(0)), F.slice("__k", F.lit(2), F.greatest(F.size("__k"), F.lit(1)))
    mean = F.try_divide(F.aggregate("__k", F.lit(0.0), lambda a, x: a + x["v"]), F.size("__k"))
    below = F.try_divide(F.size(F.filter(prior, lambda x: x["v"] <= now["v"])), F.size(prior))
    return rows.select(*keys, F.when(ok, now["p"]).alias("latest_period"), F.when(ok, now["v"]).alias("latest"), F.size("__k").alias("n"), F.when(ok, mean).alias("mean"), F.when(ok, below).alias("share_below"), "declined")
