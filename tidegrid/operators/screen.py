"""Projections and predicates on landed or stored rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import share_pct
from tidegrid.functions.time import MARKET_TZ, local_month, to_local
from tidegrid.operators.blocks import attach
from tidegrid.operators.quantiles import quantile_columns

# Accepted price range in EUR/MWh.
PRICE_MIN, PRICE_MAX = -500.0, 3000.0

# Months of the compared seasons.
SEASONS = {"spring": (3, 4, 5), "summer": (6, 7, 8)}


def normalise_zone(zone: Column | str) -> Column:
    """``DK_1`` → ``DK1``."""
    return F.regexp_replace(zone, "_", "")


def parse_number(text: Column | str) -> Column:
    """Number or NULL; never raises on bad text."""
    text = F.col(text) if isinstance(text, str) else text
    return text.try_cast("double")


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols else None)


def time_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start ≤ ts_utc ≤ end`` (UTC wall clock)."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.where(F.col("ts_utc").between(lo, hi))


def out_of_range(price: Column | str, lo: float = PRICE_MIN, hi: float = PRICE_MAX) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return (price < lo) | (price > hi)


def price_screen(
    df: DataFrame, col: str = "price_eur_mwh", lo: float = PRICE_MIN, hi: float = PRICE_MAX
) -> DataFrame:
    """Per zone: hours, hours outside the accepted range, negative hours and share."""
    p = F.col(col)
    return df.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.count_if(out_of_range(p, lo, hi)).alias("n_out_of_range"),
        F.count_if(p < 0).alias("n_negative"),
        share_pct(p < 0).alias("negative_pct"),
    )


def in_season(df: DataFrame, season: str, day_tz: str = MARKET_TZ) -> DataFrame:
    return df.where(local_month("ts_utc", day_tz).isin(*SEASONS[season]))


def clip_to_quantiles(
    df: DataFrame, col: str, low: float = 0.001, high: float = 0.999, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``clipped``: the value held inside its series' outer quantiles."""
    edges = quantile_columns(df, col, {"clip_lo": low, "clip_hi": high}, by)
    inside = F.greatest(F.col("clip_lo"), F.least(F.col("clip_hi"), F.col(col)))
    clipped = F.when(F.col(col).isNotNull(), inside)
    return attach(df, edges, by, "left").withColumn("clipped", clipped)


def wind_columns(columns: Sequence[str], skip_actuals: bool = False) -> list[str]:
    names = [c for c in columns if "wind" in c.lower()]
    return [c for c in names if "actual" not in c.lower()] if skip_actuals else names


def null_as_zero_sum(columns: Sequence[str]) -> Column:
    return reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns], F.lit(0.0))


def with_wind_total(
    df: DataFrame, name: str = "wind_total_mw", skip_actuals: bool = False
) -> DataFrame:
    """Row-wise sum of all wind columns, NULL counted as 0."""
    return df.withColumn(name, null_as_zero_sum(wind_columns(df.columns, skip_actuals)))


def with_attribute(
    df: DataFrame, dim: DataFrame, key: str, attribute: str, default
) -> DataFrame:
    """Attribute of a small dimension by key, with a default for unknown keys."""
    return (
        df.join(dim.select(key, F.col(attribute).alias("_a")), key, "left")
        .withColumn(attribute, F.coalesce("_a", F.lit(default)))
        .drop("_a")
    )


def calendar_parts(df: DataFrame, day_tz: str = MARKET_TZ) -> DataFrame:
    """Local hour, weekday (Monday 0), month and date."""
    local = to_local("ts_utc", day_tz)
    return df.withColumns(
        {
            "hour": F.hour(local),
            "weekday": F.weekday(local),
            "month": F.month(local),
            "local_date": local.cast("date"),
        }
    )
