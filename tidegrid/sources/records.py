"""Landed API payloads and client frames → canonical series.

Landed files are cut into records while they are read (``read_records``), so a
file of any size spreads over many tasks and is never one row. Payload frames,
with one JSON document per row in ``payload``, serve responses held in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.time import hour_floor, to_utc
from tidegrid.operators.align import dedup
from tidegrid.operators.screen import parse_number
from tidegrid.sources.schemas import VALUE_COLUMNS

# Landed record fields and their stored names.
SPOT_FIELDS = {"SpotPriceEUR": "price_eur_mwh", "SpotPriceDKK": "price_dkk_mwh"}
PRODUCTION_FIELDS = {
    "TotalLoad": "total_load_mw",
    "OnshoreWindPower": "wind_onshore_mw",
    "OffshoreWindPower": "wind_offshore_mw",
    "SolarPower": "solar_mw",
    "FossilGas": "gas_mw",
    "FossilHardCoal": "coal_mw",
    "Biomass": "biomass_mw",
    "Waste": "waste_mw",
    "HydroPower": "hydro_mw",
    "ExchangeContinent": "exchange_continent_mw",
    "ExchangeNordicCountries": "exchange_nordic_mw",
    "ExchangeGreatBelt": "exchange_great_belt_mw",
}
WEATHER_TZ = "Europe/Berlin"
HOUR_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON documents, one file per row, with their ``file`` name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.input_file_name().alias("file")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The flat objects in landed JSON files, as text: ``record, file, block, at``.

    Spark's text reader splits files at every closing brace; what follows the
    last opening brace of a piece is a record. Braces inside strings are not
    expected in these files: a record with one doesn't parse and is left out.
    ``file``, ``block`` and ``at`` give the order in which records landed.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    return pieces.where(F.instr("value", "{") > 0).select(
        F.concat(F.lit("{"), F.substring_index("value", "{", -1), F.lit("}")).alias("record"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _utc_text(text):
    """UTC wall clock of a landed timestamp; a trailing Z or +00:00 is dropped."""
    bare = F.regexp_replace(text, r"(Z|[+-]00:?00)$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz")
                        for f in HOUR_FORMATS])


def _records(payloads: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One typed row per record with ``_seq``, its place in landing order.

    Takes payloads or the rows of ``read_records``. Later files and later records
    of a file come last; of payloads without a ``file`` column only the place
    inside the document counts.
    """
    names = ("HourUTC", "PriceArea", *fields)
    if "record" in payloads.columns:
        parsed = F.from_json("record", ", ".join(f"{f} string" for f in names))
        rows = payloads.select(
            F.col("file").alias("_file"), F.struct("block", "at").alias("_at"), parsed.alias("r")
        ).where("r.HourUTC IS NOT NULL AND r.PriceArea IS NOT NULL")
    else:
        inner = ", ".join(f"{f}: string" for f in names)
        parsed = F.from_json("payload", f"records array<struct<{inner}>>").getField("records")
        file = F.col("file") if "file" in payloads.columns else F.lit("")
        rows = payloads.select(file.alias("_file"), F.posexplode(parsed).alias("_at", "r"))
    return rows.select(
        _zone_from_area(F.col("r.PriceArea")).alias("zone"),
        _utc_text(F.col("r.HourUTC")).alias("ts_utc"),
        *[parse_number(F.col(f"r.{f}")).alias(name) for f, name in fields.items()],
        F.struct("_file", "_at").alias("_seq"),
    )


def _zone_from_area(area):
    """``DK1`` → ``DK_1``; other area names are kept."""
    return F.regexp_replace(area, r"^([A-Z]{2})(\d)$", "$1_$2")


def normalise_spot(payloads: DataFrame, source: str = "energinet") -> DataFrame:
    """Spot-price records → ``source, zone, ts_utc, price_eur_mwh, price_dkk_mwh``;
    of an hour landed twice the later record is kept."""
    rows = dedup(_records(payloads, SPOT_FIELDS), "_seq", "last").drop("_seq")
    return rows.select(F.lit(source).alias("source"), "zone", "ts_utc", *SPOT_FIELDS.values())


def normalise_production(payloads: DataFrame, source: str = "energinet") -> DataFrame:
    """Production/exchange records with coerced numbers: the later of repeated
    records, then the mean of each hour. Fields a payload lacks stay NULL."""
    rows = dedup(_records(payloads, PRODUCTION_FIELDS), "_seq", "last").drop("_seq")
    names = list(PRODUCTION_FIELDS.values())
    return (
        rows.groupBy("zone", hour_floor("ts_utc").alias("ts_utc"))
        .agg(*[F.avg(c).alias(c) for c in names])
        .select(F.lit(source).alias("source"), "zone", "ts_utc", *names)
    )


def wind_solar_of(production: DataFrame) -> DataFrame:
    """The wind/solar series contained in a production table."""
    return production.select("source", "zone", "ts_utc", *VALUE_COLUMNS["wind_solar_forecast"])


def load_of(production: DataFrame) -> DataFrame:
    """The load series contained in a production table."""
    return production.select(
        "source", "zone", "ts_utc", F.col("total_load_mw").alias("load_mw")
    ).where(F.col("load_mw").isNotNull())


def _header_target(name: str) -> str | None:
    low = name.lower()
    if "offshore" in low:
        return "wind_offshore_mw"
    if "onshore" in low or "wind" in low:
        return "wind_onshore_mw"
    return "solar_mw" if "solar" in low else None


def normalise_transparency(
    df: DataFrame, datatype: str, source: str = "entsoe"
) -> DataFrame:
    """Client frame keyed ``(zone, ts_utc)`` → canonical columns.

    * ``load_forecast``: the first value column is the load.
    * ``wind_solar_forecast``: headers matched by word; absent series are 0.
    * ``day_ahead_prices``: the single value column is the price.
    * ``flow``: keyed ``(from_zone, to_zone, ts_utc)`` with one value column.
    """
    keys = ["from_zone", "to_zone", "ts_utc"] if datatype == "flow" else ["zone", "ts_utc"]
    values = [c for c in df.columns if c not in keys]
    tag = F.lit(source).alias("source")

    def number(c: str):
        return F.col(f"`{c}`").try_cast("double")

    if datatype == "wind_solar_forecast":
        chosen = {}
        for c in values:
            target = _header_target(c)
            if target:
                chosen.setdefault(target, c)
        cols = [
            (number(chosen[t]) if t in chosen else F.lit(0.0)).alias(t)
            for t in VALUE_COLUMNS["wind_solar_forecast"]
        ]
        return df.select(tag, *keys, *cols)
    name = {"load_forecast": "load_mw", "day_ahead_prices": "price_eur_mwh", "flow": "flow_mw"}
    return df.select(tag, *keys, number(values[0]).alias(name[datatype]))


def normalise_weather(payloads: DataFrame, source_tz: str = WEATHER_TZ) -> DataFrame:
    """Weather documents (parallel hourly arrays in local time) → UTC rows.

    ``payloads`` has ``zone, payload``. The repeated autumn hour is resolved by
    position: its second occurrence in the array is one hour later in UTC.
    """
    names = VALUE_COLUMNS["weather"]
    inner = ", ".join(["time: array<string>", *[f"{n}: array<double>" for n in names]])
    hourly = F.from_json("payload", f"hourly struct<{inner}>").getField("hourly")
    # a variable the document lacks zips as an empty array, which pads with NULL
    absent = F.array().cast("array<double>")
    values = [F.coalesce(F.col(f"h.{n}"), absent).alias(n) for n in names]
    # hours stand in order, so a repeated one follows its first occurrence
    again = F.expr("transform(times, (t, i) -> i > 0 AND t = get(times, i - 1))").alias("again")
    rows = (
        payloads.select("zone", hourly.alias("h"))
        .withColumn("times", F.col("h.time"))
        .select(
            "zone",
            F.explode(F.arrays_zip(F.col("times").alias("time"), again, *values)).alias("_r"),
        )
    )
    local = F.try_to_timestamp(F.col("_r.time"), F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    repeated = F.col("_r.again")
    one_hour = F.expr("INTERVAL 1 HOUR")
    utc = to_utc(local, source_tz)
    # the earlier reading of an ambiguous local hour is the one before the change
    earlier = utc - one_hour
    ambiguous = F.convert_timezone(F.lit("UTC"), F.lit(source_tz), earlier) == local
    first = F.when(ambiguous, earlier).otherwise(utc)
    return rows.select(
        "zone",
        F.when(repeated, first + one_hour).otherwise(first).alias("ts_utc"),
        *[F.col(f"_r.{n}").alias(n) for n in names],
    )
