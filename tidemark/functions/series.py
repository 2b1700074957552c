"""Named statistics of one ordered series, for queries that ask for them by name.

Each takes columns of arrays, oldest first, and gives a column: null, with a reason from ``decline``, where the series is too short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Named = Callable[..., Column]
TRANSFORMS: dict[str, tuple[Named, int]] = {}


def named(least: int) -> Callable[[Named], Named]:
    """Register a statistic that needs ``least`` values."""

    def add(f: Named) -> Named:
        TRANSFORMS[f.__name__] = (f, least)
        return f

    return add


def _known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def _spread(values: Column, ddof: int) -> Column:
    """Deviation, the mean bound once: a lambda over an array of one value."""
    square = lambda m: F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    total = F.get(F.transform(F.array(_mean(values)), square), F.lit(0))
    return F.sqrt(total / F.nullif(F.size(values) - ddof, F.lit(0)))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


@named(1)
def latest(values: Column) -> Column:
    return last(_known(values))


@named(8)
def zscore(values: Column, ddof: int = 0) -> Column:
    """Of the last value among all."""
    v = _known(values)
    return F.try_divide(last(v) - _mean(v), F.nullif(_spread(v, ddof), F.lit(0.0)))


@named(5)
def percentile(values: Column) -> Column:
    """Share of the earlier values that are at most the last."""
    v = _known(values)
    prior = F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))
    return F.try_divide(F.size(F.filter(prior, lambda x: x <= last(v))).cast("double"), F.size(prior))


@named(2)
def delta(values: Column, back: int = 1) -> Column:
    v = _known(values)
    return last(v) - F.try_element_at(v, F.lit(-1 - back))


@named(2)
def pace(values: Column, back: int = 1) -> Column:
    """Change against ``back`` values before, as a share."""
    v = _known(values)
    return F.try_divide(delta(values, back), F.abs(F.try_element_at(v, F.lit(-1 - back))))


@named(3)
def trend(values: Column) -> Column:
    """Slope of the straight line over places 0, 1, ..."""
    v = _known(values)
    n = F.size(v)
    mid = (n - 1) / 2
    xy = F.aggregate(F.transform(v, lambda x, i: (i - mid) * x), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(xy * 12, (n * (n * n - 1)).cast("double"))


@named(2)
def window_change(values: Column, rows: int = 3) -> Column:
    """Last value less that of ``rows`` before, or the first if there are fewer."""
    v = _known(values)
    return last(v) - F.element_at(v, F.greatest(F.size(v) - rows, F.lit(1)).cast("int"))


@named(1)
def extremes(values: Column) -> Column:
    """Smallest and largest value with their first places from 0."""
    v = _known(values)
    return F.struct(F.array_min(v).alias("low"), (F.array_position(v, F.array_min(v)) - 1).alias("low_at"), F.array_max(v).alias("high"), (F.array_position(v, F.array_max(v)) - 1).alias("high_at"))


@named(1)
def quantiles(values: Column, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Column:
    """Interpolated quantiles."""
    v = F.array_sort(_known(values))

    def one(q: float) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(v, low), F.coalesce(F.get(v, low + 1), F.get(v, low))
        return a + (b - a) * (at - low)

    return F.array(*(one(q) for q in shares))


@named(1)
def flag_events(values: Column, window: int = 4) -> Column:
    """How many flags (values that aren't 0): in all, in the last ``window`` places, and places since the last one."""
    v = values
    flags = F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return F.struct(F.size(flags).alias("total"), F.size(F.filter(flags, lambda i: i >= F.size(v) - window)).alias("in_window"), (F.size(v) - 1 - F.array_max(flags)).alias("since"))


@named(2)
def sign_agreement(values: Column, other: Column) -> Column:
    """Share of the steps in which both series move alike."""
    steps = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.signum(F.get(s, i) - F.get(s, i - 1)))
    return _mean(F.zip_with(steps(values), steps(other), lambda a, b: (a == b).cast("double")))


@named(1)
def share_of(values: Column, total: Column) -> Column:
    return F.try_divide(last(values), last(total))


@named(2)
def revision_count(values: Column, direction: str = "any") -> Column:
    """How many times the value changed from one release to the next: up, down or any."""
    v = _known(values)
    moved = {"up": lambda a, b: b > a, "down": lambda a, b: b < a, "any": lambda a, b: b != a}[direction]
    return F.get(F.transform(F.array(v), lambda w: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.coalesce(moved(F.get(w, i - 1), F.get(w, i)), F.lit(False))))), F.lit(0))


@named(1)
def ratio(values: Column, other: Column, scale: float = 1.0) -> Column:
    """The last value over the last of another series; null over 0 or where the last pair is not whole."""
    return F.try_divide(last(values) * scale, F.nullif(last(other), F.lit(0.0)))


@named(1)
def expiry_spread(values: Column, labels: Column, near: str, far: str) -> Column:
    """The value at the label ``far`` less that at ``near``; null if either is absent or occurs twice."""
    at = lambda name: F.filter(F.zip_with(values, labels, lambda v, n: F.struct(v.alias("v"), n.alias("n"))), lambda x: x["n"] == name)
    one = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))["v"])
    return one(at(far)) - one(at(near))


@named(3)
def volatility(values: Column) -> Column:
    """Sample deviation of the changes."""
    v = _known(values)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.get(v, i) - F.get(v, i - 1))
    return _spread(steps, 1)


@named(2)
def drawdown(values: Column) -> Column:
    """Fall of the last value from the largest so far, as a share."""
    v = _known(values)
    return F.try_divide(last(v), F.array_max(v)) - 1


@named(1)
def missing_share(values: Column) -> Column:
    return 1 - F.size(_known(values)) / F.nullif(F.size(values), F.lit(0))


@named(1)
def mean(values: Column) -> Column:
    return _mean(_known(values))


@named(2)
def spread(values: Column) -> Column:
    return _spread(_known(values), 1)


@named(1)
def turning_points(values: Column) -> Column:
    """Places where the series changes its direction."""
    v = _known(values)
    inner = F.sequence(F.lit(1), F.greatest(F.size(v) - 2, F.lit(1)))
    return F.size(F.filter(inner, lambda i: (F.get(v, i) - F.get(v, i - 1)) * (F.get(v, i + 1) - F.get(v, i)) < 0))


def decline(name: str, values: Column) -> Column:
    """Why a statistic has no value: unknown_transform, too_few_values, or null if it has one."""
    if name not in TRANSFORMS:
        return F.lit("unknown_transform")
    return F.when(F.size(_known(values)) < TRANSFORMS[name][1], "too_few_values")


def compute(name: str, values: Column, *more) -> Column:
    f, least = TRANSFORMS[name]
    return F.when(F.size(_known(values)) >= least, f(values, *more))
