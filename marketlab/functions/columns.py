"""Column kit shared by all operators.

Arithmetic follows one rule: a missing input gives a missing output unless a
default is stated. ``least``/``greatest`` skip NULL in Spark, so bounds are
guarded here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOW = 1e-6
HIGH = 1.0 - 1e-6


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: float) -> Column:
    return F.lit(float(x))


def number(x: Column | str, default: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Numeric reading of any column: bad text is missing, then default, then bounds."""
    c = col(x).try_cast("double")
    c = F.when(~F.isnan(c), c)
    if default is not None:
        c = F.coalesce(c, lit(default))
    return clip(c, low, high)


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    c = col(x)
    out = c
    if low is not None:
        out = F.greatest(out, lit(low))
    if high is not None:
        out = F.least(out, lit(high))
    if low is None and high is None:
        return c
    return F.when(c.isNotNull(), out)


def smaller(a: Column, b: Column) -> Column:
    """Minimum that is missing when either side is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """Division that is missing, not an error, when the divisor is zero."""
    return F.try_divide(a, b)


def float_ratio(a: Column, b: Column) -> Column:
    """Division of doubles as SQL engines with IEEE numbers give it: by zero it is infinite, or no number for 0 / 0."""
    return F.when(b == 0, a * lit(float("inf"))).otherwise(F.try_divide(a, b))


def logistic(x: Column) -> Column:
    return lit(1.0) / (lit(1.0) + F.exp(-x))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 from a condition, missing counted as false."""
    return F.when(cond, lit(1.0)).otherwise(lit(0.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / lit(3_600_000_000.0)


def has(df: DataFrame, *names: str) -> bool:
    return set(names).issubset(df.columns)


def optional(df: DataFrame, name: str, default: float | None = None) -> Column:
    """A numeric column, or the default when the frame has no such column."""
    if name in df.columns:
        return number(F.col(name), default)
    return lit(default) if default is not None else F.lit(None).cast("double")


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, missing instead of an error when a side is constant."""
    x, y = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sharpe(x: Column, periods: float = 8760.0) -> Column:
    """Annualised mean over population deviation, 0 below three points."""
    sd = F.stddev_pop(x)
    return F.when((F.count(x) >= 3) & (sd > 0), F.avg(x) / sd * lit(periods**0.5)).otherwise(lit(0.0))
