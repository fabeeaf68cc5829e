"""Look-ahead-safe features for every zone in one plan.

Lags and rolling windows count hours, not rows: frames range over the hour
number, so a series with missing hours needs no filled grid. Rows must be
unique per hour (``align.to_grid`` or ``align.merged_hours`` see to that).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import pearson
from tidegrid.functions.time import (
    MARKET_TZ,
    is_danish_holiday,
    local_weekday,
    to_local,
)
from tidegrid.operators.align import merged_hours
from tidegrid.operators.blocks import attach, frame_moments, hours_back, trailing
from tidegrid.operators.screen import null_as_zero_sum, wind_columns

PRICE = "price_eur_mwh"
WEEK = 168
#: The week of hours that ends a day before the hour at hand.
LAST_WEEK = (-(WEEK + 23), -24)

# When each feature is known, relative to delivery day D.
FEATURE_AVAILABILITY = {
    "price_lag_1d": "D-1 13:00 CET",
    "price_lag_2d": "D-2 13:00 CET",
    "price_lag_7d": "D-7 13:00 CET",
    "price_rolling_7d_mean": "D-1 13:00 CET",
    "price_rolling_7d_std": "D-1 13:00 CET",
    "load_forecast": "D-1 10:00 CET",
    "wind_forecast": "D-1 10:00 CET",
    "solar_forecast": "D-1 10:00 CET",
    "wind_forecast_error_lag1": "D-1 end of day",
    "residual_load": "D-1 10:00 CET",
    "cross_border_flow": "D-1 14:00 CET",
    "hour_sin": "always",
    "hour_cos": "always",
    "weekday_sin": "always",
    "weekday_cos": "always",
    "is_weekend": "always",
    "is_holiday": "always",
}

LAG_FEATURES = (
    "price_lag_1d",
    "price_lag_2d",
    "price_lag_7d",
    "price_rolling_7d_mean",
    "price_rolling_7d_std",
    "price_rolling_24h_min",
    "price_rolling_24h_max",
)
CALENDAR_FEATURES = (
    "hour_sin",
    "hour_cos",
    "weekday_sin",
    "weekday_cos",
    "is_weekend",
    "is_holiday",
)


def _lag_columns(price: str):
    """Window expressions of the seven price features; they reach 191 hours back."""

    def build(w):
        p = F.col(price)
        seen_week, mean, deviation = frame_moments(price, *LAST_WEEK)
        day = w.rangeBetween(-47, -24)
        seen_day = F.count(p).over(day)
        return {
            "price_lag_1d": hours_back(price, 24, w),
            "price_lag_2d": hours_back(price, 48, w),
            "price_lag_7d": hours_back(price, WEEK, w),
            "price_rolling_7d_mean": F.when(seen_week >= 24, mean),
            "price_rolling_7d_std": F.when(seen_week >= 24, deviation),
            "price_rolling_24h_min": F.when(seen_day >= 24, F.min(p).over(day)),
            "price_rolling_24h_max": F.when(seen_day >= 24, F.max(p).over(day)),
        }

    return build


def lag_features(
    prices: DataFrame, price_col: str = PRICE, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Three lags, the 24-hour-shifted weekly mean and deviation (24 values
    needed) and the shifted daily minimum and maximum (all 24 needed)."""
    rows = prices.select(*by, "ts_utc", price_col)
    return trailing(rows, WEEK + 23, _lag_columns(price_col), by, moments=[(price_col, *LAST_WEEK)])


def calendar_features(
    df: DataFrame,
    day_tz: str = MARKET_TZ,
    holidays: DataFrame | None = None,
    country: str = "DK",
) -> DataFrame:
    """Cyclic local hour and weekday, weekend flag and holiday flag.

    ``holidays`` is an optional (country, date) table; without it the Danish
    calendar rule applies, computed per row with no join.
    """
    local = to_local("ts_utc", day_tz)
    hour, weekday = F.hour(local), F.weekday(local)
    out = df.withColumns(
        {
            "hour_sin": F.sin(hour * (2 * math.pi) / 24),
            "hour_cos": F.cos(hour * (2 * math.pi) / 24),
            "weekday_sin": F.sin(weekday * (2 * math.pi) / 7),
            "weekday_cos": F.cos(weekday * (2 * math.pi) / 7),
            "is_weekend": weekday >= 5,
        }
    )
    if holidays is None:
        return out.withColumn("is_holiday", is_danish_holiday(local.cast("date")))
    days = holidays.where(F.col("country") == country).select(F.col("date").alias("_date"))
    return (
        out.withColumn("_local", local.cast("date"))
        .join(days.distinct(), F.col("_local") == F.col("_date"), "left")
        .withColumn("is_holiday", F.col("_date").isNotNull())
        .drop("_local", "_date")
    )


def residual_load(load: DataFrame, wind_solar: DataFrame) -> DataFrame:
    """Load minus wind minus solar at each load hour; a missing part gives NULL."""
    supply = wind_solar.select(
        "zone",
        "ts_utc",
        null_as_zero_sum(wind_columns(wind_solar.columns)).alias("wind_mw"),
        "solar_mw",
    )
    return load.select("zone", "ts_utc", "load_mw").join(supply, ["zone", "ts_utc"], "left").select(
        "zone",
        "ts_utc",
        "load_mw",
        "wind_mw",
        "solar_mw",
        (F.col("load_mw") - F.col("wind_mw") - F.col("solar_mw")).alias("residual_load_mw"),
    )


def _capacity_factor(total: str):
    def build(w):
        frame = w.rangeBetween(-(WEEK - 1), 0)
        peak = F.when(F.count(total).over(frame) >= 24, F.max(total).over(frame))
        factor = F.when(peak > 0, F.col(total) / F.nullif(peak, F.lit(0.0))).otherwise(F.lit(0.0))
        return {"wind_capacity_factor": factor}

    return build


def wind_features(
    forecast: DataFrame, actuals: DataFrame | None = None, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Wind total, capacity factor against the trailing weekly peak, and the
    forecast error known a day later (NULL without actuals)."""
    names = wind_columns(forecast.columns, skip_actuals=True)
    rows = forecast.select(*by, "ts_utc", *names, null_as_zero_sum(names).alias("wind_total_mw"))
    if actuals is not None:
        seen = actuals.select(*by, "ts_utc", "wind_actual_mw")
        rows = rows.join(seen, [*by, "ts_utc"], "left")
        error = F.col("wind_actual_mw") - F.col("wind_total_mw")
    else:
        error = F.lit(None).cast("double")
    rows = rows.withColumn("_error", error)
    hourly = merged_hours({"wind": (rows, ["wind_total_mw", "_error"])}, by)

    def build(w):
        return {
            **_capacity_factor("wind_total_mw")(w),
            "wind_forecast_error_lag1": hours_back("_error", 24, w),
        }

    return trailing(hourly, WEEK, build, by).select(
        *by, "ts_utc", "wind_total_mw", "wind_capacity_factor", "wind_forecast_error_lag1"
    )


def flow_features(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Flow and use of capacity in percent per interconnector and hour."""
    return flows.join(edges, ["from_zone", "to_zone"], "left").select(
        "from_zone",
        "to_zone",
        "ts_utc",
        "flow_mw",
        (F.abs("flow_mw") / F.col("capacity_mw") * 100).alias("util_pct"),
    )


def flow_columns(flows: DataFrame, edges: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """The listed interconnectors as ``flow_A_B_mw`` / ``util_A_B_pct`` columns."""
    rows = flow_features(flows, edges)
    aggs = []
    for a, b in labels:
        here = (F.col("from_zone") == a) & (F.col("to_zone") == b)
        aggs.append(F.max(F.when(here, F.col("flow_mw"))).alias(f"flow_{a}_{b}_mw"))
        aggs.append(F.max(F.when(here, F.col("util_pct"))).alias(f"util_{a}_{b}_pct"))
    return rows.groupBy("ts_utc").agg(*aggs)


def feature_matrix(
    prices: DataFrame,
    load: DataFrame | None = None,
    wind_solar: DataFrame | None = None,
    actuals: DataFrame | None = None,
    flows: DataFrame | None = None,
    edges: DataFrame | None = None,
    flow_labels: Sequence[tuple[str, str]] = (),
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
    complete: bool = False,
) -> DataFrame:
    """All features at every price hour; price-only without load and wind.

    Prices, load, wind/solar and actuals are merged by hour in one aggregation,
    then one blocked window computes every lag and rolling column: two shuffles
    in total, whatever the number of inputs.

    ``complete`` keeps only rows that can train a model: every column present,
    except columns a zone has no data for at all (price-only zones, wind error
    without actuals).
    """
    frames: dict[str, tuple[DataFrame, list[str]]] = {"price": (prices, [PRICE])}
    full = load is not None and wind_solar is not None
    winds: list[str] = []
    solar: list[str] = []
    if full:
        winds = wind_columns(wind_solar.columns, skip_actuals=True)
        solar = [c for c in wind_solar.columns if "solar" in c.lower()][:1]
        frames["supply"] = (wind_solar, winds + solar)
        frames["load"] = (load, ["load_mw"])
        if actuals is not None:
            frames["actual"] = (actuals, ["wind_actual_mw"])
    hourly = merged_hours(frames, by)

    if full:
        total = F.when(F.col("has_supply"), null_as_zero_sum(winds))
        sun = F.col(solar[0]) if solar else F.when(F.col("has_supply"), F.lit(0.0))
        hourly = hourly.withColumns({"wind_total_mw": total, "_sun": sun}).withColumn(
            "residual_load_mw", F.col("load_mw") - F.col("wind_total_mw") - F.col("_sun")
        )
        if actuals is not None:
            hourly = hourly.withColumn("_error", F.col("wind_actual_mw") - F.col("wind_total_mw"))

    def build(w):
        made = _lag_columns(PRICE)(w)
        if full:
            made |= _capacity_factor("wind_total_mw")(w)
            if actuals is not None:
                made["wind_forecast_error_lag1"] = hours_back("_error", 24, w)
        return made

    rows = trailing(hourly, WEEK + 23, build, by, moments=[(PRICE, *LAST_WEEK)]).where("has_price")
    if full:
        # no wind row at this hour: no capacity factor either
        rows = rows.withColumn(
            "wind_capacity_factor", F.when(F.col("has_supply"), F.col("wind_capacity_factor"))
        )
    rows = calendar_features(rows, day_tz)
    names = [PRICE, *LAG_FEATURES, *CALENDAR_FEATURES]
    optional = []
    if full:
        optional = ["residual_load_mw", "load_mw", "wind_total_mw", "wind_capacity_factor"]
        if actuals is not None:
            optional.append("wind_forecast_error_lag1")
        optional += solar
    out = rows.select(*by, "ts_utc", *names, *optional)
    if complete:
        out = out.na.drop(subset=[PRICE, *LAG_FEATURES])
        if optional:
            out = _where_complete(out, _presence(hourly, optional, by), optional, by)
    if flows is not None and flow_labels:
        out = out.join(flow_columns(flows, edges, flow_labels), "ts_utc", "left")
    return out


def _presence(hourly: DataFrame, optional: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per zone: which optional columns have any value at a price hour.

    Read off the merged hours before any window. Counting every merged column
    keeps this branch's shuffle identical to the main one, so Spark reuses it
    instead of merging the inputs twice.
    """
    sources = {
        "wind_capacity_factor": "wind_total_mw",
        "wind_forecast_error_lag1": "_error",
    }
    at_price = F.col("has_price")
    merged = [c for c in hourly.columns if c not in (*by, "ts_utc") and not c.startswith("has_")]
    return hourly.groupBy(*by).agg(
        *[
            (F.count(F.when(at_price, F.col(sources.get(c, c)))) > 0).alias(f"_has_{c}")
            for c in optional
        ],
        F.count(F.coalesce(*merged)).alias("_any"),
    )


def _where_complete(
    rows: DataFrame, presence: DataFrame, cols: Sequence[str], by: Sequence[str]
) -> DataFrame:
    whole = reduce(and_, [F.col(c).isNotNull() | ~F.col(f"_has_{c}") for c in cols])
    if "_any" in presence.columns:
        whole = whole & (F.col("_any") > 0)
    return attach(rows, presence, by).where(whole).select(*rows.columns)


def feature_names(matrix: DataFrame, target: str = PRICE) -> list[str]:
    return [c for c in matrix.columns if c not in ("zone", "ts_utc", target)]


def model_rows(matrix: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """The ``complete`` rule applied to a stored matrix: rows complete in every
    column their zone has data for. Reads its input twice, so give it a table;
    ``feature_matrix(complete=True)`` avoids the second pass."""
    cols = [c for c in matrix.columns if c not in (*by, "ts_utc")]
    used = matrix.groupBy(*by).agg(*[(F.count(c) > 0).alias(f"_has_{c}") for c in cols])
    return _where_complete(matrix, used, cols, by)


def warm_up(
    matrix: DataFrame, complete: DataFrame, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Rows of the full and of the complete matrix, and the difference, per zone."""
    before = matrix.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    after = complete.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_after"))
    return (
        before.join(after, list(by), "left")
        .withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
        .withColumn("dropped", F.col("rows_before") - F.col("rows_after"))
    )


def known_at_gate(availability: Column | str, gate_hour: int = 12) -> Column:
    """True for ``always`` and for ``D-n HH:MM`` at or before noon of D-1."""
    text = F.col(availability) if isinstance(availability, str) else availability
    back = F.regexp_extract(text, r"^D-(\d+)", 1).try_cast("int")
    minute = (
        F.regexp_extract(text, r"(\d{2}):(\d{2})", 1).try_cast("int") * 60
        + F.regexp_extract(text, r"(\d{2}):(\d{2})", 2).try_cast("int")
    )
    by_noon = (back == 1) & (F.coalesce(minute, F.lit(24 * 60)) <= gate_hour * 60)
    return F.coalesce((text == "always") | (back > 1) | by_noon, F.lit(False))


#: The availability rule that a column of the matrix falls under, where its name differs.
RULE_OF_COLUMN = {
    "price_rolling_24h_min": "price_rolling_7d_mean",
    "price_rolling_24h_max": "price_rolling_7d_mean",
    "load_mw": "load_forecast",
    "wind_total_mw": "wind_forecast",
    "wind_onshore_mw": "wind_forecast",
    "wind_offshore_mw": "wind_forecast",
    "wind_capacity_factor": "wind_forecast",
    "solar_mw": "solar_forecast",
    "residual_load_mw": "residual_load",
}
#: Column families, by prefix.
RULE_OF_FAMILY = {"flow_": "cross_border_flow", "util_": "cross_border_flow"}


def availability_of(column: str, availability: dict[str, str]) -> str | None:
    """When a matrix column is known; None if no rule speaks of it."""
    family = next((r for p, r in RULE_OF_FAMILY.items() if column.startswith(p)), None)
    return availability.get(column, availability.get(RULE_OF_COLUMN.get(column, family)))


def gate_closure_features(
    matrix: DataFrame,
    availability: dict[str, str] | None = None,
    gate_hour: int = 12,
    keys: Sequence[str] = ("zone", "ts_utc"),
    target: str = PRICE,
) -> DataFrame:
    """The matrix without the columns published after the gate.

    Every column but the keys and the target must have a rule, its own or that
    of ``RULE_OF_COLUMN`` or its family; a column without one is an error.
    """
    rules = availability or FEATURE_AVAILABILITY
    when = {c: availability_of(c, rules) for c in matrix.columns if c not in (*keys, target)}
    if unknown := [c for c, w in when.items() if w is None]:
        raise ValueError(f"no availability rule for {unknown}")
    return matrix.drop(*[c for c, w in when.items() if not _known(w, gate_hour)])


def _known(when: str, gate_hour: int) -> bool:
    if when == "always":
        return True
    day, _, rest = when.partition(" ")
    back = int(day.removeprefix("D-"))
    clock = rest.split(" ")[0]
    if back != 1:
        return back > 1
    if ":" not in clock:
        return False
    hour, minute = clock.split(":")
    return int(hour) * 60 + int(minute) <= gate_hour * 60


def similar_day(
    prices: DataFrame, col: str = PRICE, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Similar-day ``baseline``: yesterday for Tue–Fri, last week otherwise."""

    def build(w):
        weekly = local_weekday("ts_utc", day_tz).isin(0, 5, 6)
        return {
            "baseline": F.when(weekly, hours_back(col, WEEK, w)).otherwise(hours_back(col, 24, w))
        }

    return trailing(prices, WEEK, build, by)


def rolling_volatility(
    df: DataFrame, col: str = PRICE, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Trailing 7-day deviation including the current hour, 24 values needed."""

    def build(w):
        seen, _, deviation = frame_moments(col, -(WEEK - 1), 0)
        return {"rolling_7d_std": F.when(seen >= 24, deviation)}

    return trailing(df, WEEK - 1, build, by, moments=[(col, -(WEEK - 1), 0)])


def look_ahead_demo(
    prices: DataFrame, col: str = PRICE, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Correlation with the 1-hour and the 24-hour lag, and the inflation of
    the (illegitimate) former over the latter in percent."""

    def build(w):
        return {"lag_1": hours_back(col, 1, w), "lag_24": hours_back(col, 24, w)}

    both = trailing(prices, 24, build, by)
    return (
        both.groupBy(*by)
        .agg(
            pearson(F.col(col), F.col("lag_1")).alias("r_1h"),
            pearson(F.col(col), F.col("lag_24")).alias("r_24h"),
        )
        .withColumn(
            "inflation_pct",
            (F.col("r_1h") / F.nullif(F.col("r_24h"), F.lit(0.0)) - 1) * 100,
        )
    )
