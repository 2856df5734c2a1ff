"""Numeric expressions that behave under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are known; null for a constant side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def known(x: Column) -> Column:
    """NaN as null."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def dropout_share(wer: Column) -> Column:
    """Share of a target's errors that is spent on contiguous loss."""
    return F.when(wer <= 0.20, 0.0).when(wer <= 0.35, 0.10).otherwise(0.20)
