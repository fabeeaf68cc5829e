"""Declared schemas of the stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Value columns per stored datatype.
VALUE_COLUMNS = {
    "day_ahead_prices": ("price_eur_mwh", "price_dkk_mwh"),
    "wind_solar_forecast": ("wind_onshore_mw", "wind_offshore_mw", "solar_mw"),
    "load_forecast": ("load_mw",),
    "production_exchange": (
        "total_load_mw",
        "wind_onshore_mw",
        "wind_offshore_mw",
        "solar_mw",
        "gas_mw",
        "coal_mw",
        "biomass_mw",
        "waste_mw",
        "hydro_mw",
        "exchange_continent_mw",
        "exchange_nordic_mw",
        "exchange_great_belt_mw",
    ),
    "weather": (
        "temperature_2m",
        "wind_speed_10m",
        "wind_speed_100m",
        "direct_radiation",
        "diffuse_radiation",
    ),
}


def series_schema(datatype: str) -> StructType:
    values = ", ".join(f"{c} double" for c in VALUE_COLUMNS[datatype])
    return StructType.fromDDL(
        f"zone string, ts_utc timestamp_ntz, {values}, source string, month string"
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark's NaN is a value; missing data is NULL everywhere in this library."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
