"""Landed files → canonical tables → stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources import exports, records
from tidegrid.sources.schemas import VALUE_COLUMNS
from tidegrid.sources.store import merge_into


def _stored_shape(df: DataFrame, datatype: str) -> DataFrame:
    """All value columns of the stored table, absent ones NULL."""
    values = [
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)
        for c in VALUE_COLUMNS[datatype]
    ]
    return df.select("source", "zone", "ts_utc", *values)


def ingest_payloads(
    spark: SparkSession, spot_path: str, production_path: str, root: str
) -> None:
    """Spot-price and production documents into prices, production, wind/solar
    and load. Overlapping documents: the later file wins."""
    spot = records.normalise_spot(records.read_records(spark, spot_path))
    prices = spot.where(F.col("price_eur_mwh").isNotNull())
    merge_into(_stored_shape(prices, "day_ahead_prices"), root, "day_ahead_prices")

    production = records.normalise_production(records.read_records(spark, production_path))
    merge_into(_stored_shape(production, "production_exchange"), root, "production_exchange")
    merge_into(records.wind_solar_of(production), root, "wind_solar_forecast")
    merge_into(records.load_of(production), root, "load_forecast")


def ingest_exports(spark: SparkSession, path: str, source_tz: str, root: str) -> None:
    """Manually exported files into the stored prices, wind/solar and load."""
    tables = exports.import_exports(spark, path, source_tz)
    for datatype in ("day_ahead_prices", "wind_solar_forecast", "load_forecast"):
        merge_into(_stored_shape(tables[datatype], datatype), root, datatype)
