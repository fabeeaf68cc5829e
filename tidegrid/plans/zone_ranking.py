"""Attractiveness and earnings reports over zones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegrid.operators import profiles, trading


def attractiveness_report(
    prices: DataFrame, zones: DataFrame, wind_solar: DataFrame | None, load: DataFrame | None
) -> DataFrame:
    """Zone metrics, their normalised score and the rank by it."""
    metrics = profiles.zone_metrics(prices, zones, wind_solar, load)
    return profiles.ranked(profiles.attractiveness(metrics), "attractiveness")


def earnings_report(summary: DataFrame, zones: DataFrame, position_mwh: float = 10.0) -> DataFrame:
    """Annualised earnings per zone, ranked by the base case."""
    table = trading.earnings(summary, zones, position_mwh)
    return profiles.ranked(table, "net_base_case")
