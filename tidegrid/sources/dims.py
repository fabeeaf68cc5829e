"""Static dimensions as small literal tables.

They are written as VALUES so Spark knows their size and may broadcast them by
its own threshold; nothing here grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators.features import FEATURE_AVAILABILITY

# Zone, label, area code, latitude, longitude, entry cost EUR,
# annual cost EUR.
ZONES = (
    ("DK_1", "West Denmark", "10YDK-1--------W", 56.0, 9.0, 25000, 15000),
    ("DK_2", "East Denmark", "10YDK-2--------M", 55.5, 12.0, 25000, 15000),
    ("NO_1", "South-East Norway", "10YNO-1--------2", 60.0, 11.0, 25000, 15000),
    ("NO_2", "South Norway", "10YNO-2--------T", 58.5, 7.5, 25000, 15000),
    ("NO_3", "Middle Norway", "10YNO-3--------J", 63.5, 10.5, 25000, 15000),
    ("NO_4", "North Norway", "10YNO-4--------9", 69.0, 18.0, 25000, 15000),
    ("NO_5", "West Norway", "10Y1001A1001A48H", 60.5, 5.5, 25000, 15000),
    ("SE_1", "North Sweden", "10Y1001A1001A44P", 66.5, 18.0, 25000, 15000),
    ("SE_2", "North-Central Sweden", "10Y1001A1001A45N", 63.0, 16.0, 25000, 15000),
    ("SE_3", "Central Sweden", "10Y1001A1001A46L", 59.5, 16.0, 25000, 15000),
    ("SE_4", "South Sweden", "10Y1001A1001A47J", 56.5, 14.0, 25000, 15000),
    ("FI", "Finland", "10YFI-1--------U", 63.0, 26.0, 30000, 18000),
    ("DE_LU", "Germany-Luxembourg", "10Y1001A1001A82H", 51.0, 10.0, 50000, 35000),
    ("NL", "Netherlands", "10YNL----------L", 52.3, 5.0, 45000, 30000),
    ("BE", "Belgium", "10YBE----------2", 50.8, 4.5, 45000, 30000),
    ("FR", "France", "10YFR-RTE------C", 46.5, 2.5, 55000, 40000),
    ("AT", "Austria", "10YAT-APG------L", 47.5, 14.0, 45000, 30000),
    ("PL", "Poland", "10YPL-AREA-----S", 52.0, 20.0, 40000, 25000),
    ("EE", "Estonia", "10Y1001A1001A39I", 58.8, 25.5, 35000, 20000),
    ("LV", "Latvia", "10YLV-1001A00074", 57.0, 24.5, 35000, 20000),
    ("LT", "Lithuania", "10YLT-1001A0008Q", 55.5, 24.0, 35000, 20000),
)

# Interconnectors with nominal capacity in MW.
INTERCONNECTORS = (
    ("DK_1", "DK_2", 600),
    ("DK_1", "DE_LU", 2500),
    ("DK_1", "NO_2", 1700),
    ("DK_1", "SE_3", 740),
    ("DK_2", "DE_LU", 600),
    ("DK_2", "SE_4", 1700),
    ("NO_1", "NO_2", 3500),
    ("NO_1", "NO_3", 1600),
    ("NO_1", "NO_5", 3900),
    ("NO_2", "NO_5", 3000),
    ("NO_3", "NO_4", 950),
    ("NO_3", "NO_5", 500),
    ("NO_1", "SE_3", 2145),
    ("NO_3", "SE_2", 1000),
    ("NO_4", "SE_1", 700),
    ("NO_4", "SE_2", 300),
    ("NO_2", "DE_LU", 1400),
    ("NO_2", "NL", 700),
    ("NO_5", "DE_LU", 1400),
    ("SE_1", "SE_2", 3300),
    ("SE_2", "SE_3", 7300),
    ("SE_3", "SE_4", 5400),
    ("SE_3", "FI", 1200),
    ("SE_4", "DE_LU", 615),
    ("SE_4", "PL", 600),
    ("SE_4", "LT", 700),
    ("FI", "EE", 1016),
    ("EE", "LV", 1400),
    ("LV", "LT", 1400),
    ("LT", "PL", 500),
    ("DE_LU", "NL", 5000),
    ("DE_LU", "BE", 1000),
    ("DE_LU", "FR", 4800),
    ("DE_LU", "AT", 5000),
    ("DE_LU", "PL", 3000),
    ("NL", "BE", 2400),
    ("FR", "BE", 4300),
    ("AT", "PL", 600),
    ("NL", "DK_1", 700),
    ("FR", "AT", 150),
)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def values_table(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Literal rows as a DataFrame; ``columns`` is a DDL list of names and types."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}"
                      for c in columns.split(", "))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")


def zones(spark: SparkSession) -> DataFrame:
    return values_table(
        spark,
        ZONES,
        "zone string, label string, area_code string, latitude double, longitude double, "
        "entry_cost_eur double, annual_cost double",
    )


def interconnectors(spark: SparkSession) -> DataFrame:
    return values_table(
        spark, INTERCONNECTORS, "from_zone string, to_zone string, capacity_mw int"
    )


def feature_availability(spark: SparkSession) -> DataFrame:
    return values_table(
        spark, list(FEATURE_AVAILABILITY.items()), "feature string, available_from string"
    )
