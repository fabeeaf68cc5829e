"""Aggregate expressions that stay defined on constant or empty input."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both sides are present; constant → NULL."""
    x, y = _pair(a, b)
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0))


def pair_count(a: Column, b: Column) -> Column:
    return F.count(F.when(a.isNotNull() & b.isNotNull(), F.lit(1)))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def smape(actual: Column, predicted: Column) -> Column:
    """Symmetric MAPE in percent; zero denominators skipped, none left → 0."""
    half = (F.abs(actual) + F.abs(predicted)) / 2
    ratio = F.when(half > 0, F.abs(actual - predicted) / F.nullif(half, F.lit(0.0)))
    return F.coalesce(F.avg(ratio) * 100, F.lit(0.0))


def share_pct(condition: Column) -> Column:
    """Percentage of rows on which ``condition`` holds."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))) * 100


def ratio_or_limit(numerator: Column, denominator: Column, sign: Column) -> Column:
    """numerator/denominator; a zero denominator gives +inf for a positive
    ``sign`` and 0 otherwise; a NULL denominator stays NULL."""
    limit = F.when(sign > 0, F.lit(math.inf)).otherwise(F.lit(0.0))
    return F.when(denominator == 0, limit).otherwise(
        numerator / F.nullif(denominator, F.lit(0.0))
    )


def tidy(c: Column, places: int = 6) -> Column:
    """Rounded for reporting, with negative zero folded to zero."""
    return F.round(c, places) + F.lit(0.0)
