"""Canonical market tables derived from the given ``events`` and ``orders``.

A zone is an event type (or a user), a price is the mean event value of the
hour in EUR less 25. Values are summed as integer cents and divided once, so
every engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.time import hour_floor
from tidegrid.sources import dims
from tidegrid.sources.dims import values_table

# Zones linked in the derived market, with capacities in MW.
EDGES = (
    ("click", "view", 500),
    ("view", "purchase", 400),
    ("purchase", "signup", 300),
    ("signup", "error", 200),
    ("error", "click", 100),
)

# Label and costs of the derived zones.
ZONE_DIM = (
    ("click", "Click zone", 25000, 15000),
    ("view", "View zone", 30000, 18000),
    ("purchase", "Purchase zone", 50000, 35000),
    ("signup", "Signup zone", 45000, 30000),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * 100).cast("bigint")


def share_key() -> Column:
    """The integer in ``props``, 0 … 99; splits events over plant types."""
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str, zone: Column | str = "event_type") -> DataFrame:
    zone = F.col(zone) if isinstance(zone, str) else zone
    return table(spark, sf_dir, "events").withColumn("zone", zone.cast("string"))


def twenty_zones() -> Column:
    """Zones by fives of the share key: dense hourly series at sf0.1."""
    return F.concat(F.lit("Z"), F.floor(share_key() / 5))


def market_zones() -> Column:
    """The real market zones in turn, by the share key."""
    names = F.array(*[F.lit(z[0]) for z in dims.ZONES])
    return F.get(names, share_key() % len(dims.ZONES))


def source_of() -> Column:
    """Which source delivered an event: by the half minute it falls into."""
    return F.when(F.second("ts") < 30, "energinet").otherwise("entsoe")


def _hourly_price(rows: DataFrame, *keys: str) -> DataFrame:
    return (
        rows.groupBy(*keys, hour_floor("ts").alias("ts_utc"))
        .agg(F.sum(cents("value")).alias("_c"), F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "ts_utc", (F.col("_c") / (F.col("_n") * 100.0) - 25.0).alias("price_eur_mwh")
        )
    )


def prices(spark: SparkSession, sf_dir: str, zone: Column | str = "event_type") -> DataFrame:
    return _hourly_price(events(spark, sf_dir, zone), "zone")


def prices_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("source", source_of())
    return _hourly_price(rows, "source", "zone")


def wind_solar(spark: SparkSession, sf_dir: str, zone: Column | str = "event_type") -> DataFrame:
    k, c = share_key(), cents("value")
    day_hours = F.hour("ts").between(7, 18)
    solar = F.sum(F.when((k >= 67) & day_hours, c).otherwise(F.lit(0).cast("bigint"))) / 100.0
    return (
        events(spark, sf_dir, zone)
        .groupBy("zone", hour_floor("ts").alias("ts_utc"))
        .agg(
            (F.sum(F.when(k < 34, c)) / 10.0).alias("wind_onshore_mw"),
            (F.sum(F.when((k >= 34) & (k < 67), c)) / 10.0).alias("wind_offshore_mw"),
            solar.alias("solar_mw"),
        )
    )


def wind_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onshore wind per source; NULL where a source saw none in an hour."""
    return (
        events(spark, sf_dir)
        .groupBy(source_of().alias("source"), "zone", hour_floor("ts").alias("ts_utc"))
        .agg((F.sum(F.when(share_key() < 34, cents("value"))) / 10.0).alias("wind_onshore_mw"))
    )


def load(spark: SparkSession, sf_dir: str, zone: Column | str = "event_type") -> DataFrame:
    return (
        events(spark, sf_dir, zone)
        .groupBy("zone", hour_floor("ts").alias("ts_utc"))
        .agg((F.sum(cents("value")) / 100.0 + 3000.0).alias("load_mw"))
    )


def actuals(spark: SparkSession, sf_dir: str, zone: Column | str = "event_type") -> DataFrame:
    """Metered wind per zone and hour, from the values alone."""
    return (
        events(spark, sf_dir, zone)
        .groupBy("zone", hour_floor("ts").alias("ts_utc"))
        .agg((F.sum(cents("value")) / 10.0).alias("wind_actual_mw"))
    )


def edges(spark: SparkSession) -> DataFrame:
    return values_table(spark, EDGES, "from_zone string, to_zone string, capacity_mw int")


def zone_dim(spark: SparkSession) -> DataFrame:
    return values_table(
        spark, ZONE_DIM, "zone string, label string, entry_cost_eur double, annual_cost double"
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly flow on each link: the net event value of its two zones."""
    hourly = (
        events(spark, sf_dir)
        .groupBy("zone", hour_floor("ts").alias("ts_utc"))
        .agg(F.sum(cents("value")).alias("_c"))
    )
    left = hourly.select(F.col("zone").alias("from_zone"), "ts_utc", F.col("_c").alias("_a"))
    right = hourly.select(F.col("zone").alias("to_zone"), "ts_utc", F.col("_c").alias("_b"))
    return (
        edges(spark)
        .select("from_zone", "to_zone")
        .join(left, "from_zone")
        .join(right, ["to_zone", "ts_utc"])
        .select(
            "from_zone", "to_zone", "ts_utc", ((F.col("_a") - F.col("_b")) / 100.0).alias("flow_mw")
        )
    )


def error_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model-error observation per order priority and day."""
    c = cents("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("zone"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("ts_utc"),
        )
        .agg(F.sum(c).alias("_c"), F.count(F.lit(1)).alias("_n"))
        .select("zone", "ts_utc", (F.col("_c") / (F.col("_n") * 1000000.0)).alias("mae"))
    )


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly series of several years from ``orders``: the price is the mean order total in
    thousands less 25, the hour is the key's; every tenth order falls into a sparse second zone.
    ``demand`` is a second number per hour."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.when(F.col("o_orderkey") % 10 == 0, "minor").otherwise("main").alias("zone"),
            (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int")))
            .alias("ts_utc"),
            cents("o_totalprice").alias("_c"), (F.col("o_custkey") % 100).alias("_k"),
        )
        .groupBy("zone", "ts_utc")
        .agg(F.sum("_c").alias("_c"), F.sum("_k").alias("_k"), F.count(F.lit(1)).alias("_n"))
        .select(
            "zone", "ts_utc", (F.col("_c") / (F.col("_n") * 100000.0) - 25.0).alias("price_eur_mwh"),
            (F.col("_k") / (F.col("_n") * 1.0)).alias("demand"),
        )
    )
