"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, registry, rounded, sql
from tidegrid.operators import screen
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()


@query(
    "b01_normalise_zone",
    """SELECT replace(event_type || '_' || user_id, '_', '') AS zone, count(*) AS n
FROM events GROUP BY 1""",
)
def _(spark, d):
    code = F.concat_ws("_", "event_type", "user_id")
    rows = market.table(spark, d, "events").select(screen.normalise_zone(code).alias("zone"))
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b02_parse_number",
    """SELECT event_type AS zone, count(try_cast(props AS DOUBLE)) AS n_props,
  count(try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS n_k,
  CAST(sum(try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS DOUBLE) AS sum_k
FROM events GROUP BY 1""",
)
def _(spark, d):
    k = screen.parse_number(F.regexp_extract("props", r"([0-9]+)", 1))
    return market.events(spark, d).groupBy("zone").agg(
        F.count(screen.parse_number("props")).alias("n_props"),
        F.count(k).alias("n_k"),
        F.sum(k).alias("sum_k"),
    )


@query(
    "b03_complete_rows",
    sql(
        """SELECT * FROM ws WHERE wind_onshore_mw IS NOT NULL AND wind_offshore_mw IS NOT NULL
  AND solar_mw IS NOT NULL""",
        "ws",
    ),
)
def _(spark, d):
    return screen.complete_rows(market.wind_solar(spark, d))


@query(
    "b04_time_slice",
    sql(
        """SELECT * FROM p
WHERE ts_utc BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""",
        "p",
    ),
)
def _(spark, d):
    return screen.time_slice(
        market.prices(spark, d), "2024-01-08 06:00:00", "2024-01-20 18:00:00"
    )


@query(
    "b05_price_range_and_negatives",
    sql(
        """SELECT zone, count(*) AS n_hours,
  count(*) FILTER (WHERE price_eur_mwh < -24 OR price_eur_mwh > 150) AS n_out_of_range,
  count(*) FILTER (WHERE price_eur_mwh < 0) AS n_negative,
  avg(CASE WHEN price_eur_mwh < 0 THEN 1e0 ELSE 0e0 END) * 100 AS negative_pct
FROM p GROUP BY zone""",
        "p",
        "negative_pct",
    ),
)
def _(spark, d):
    return rounded(screen.price_screen(market.prices(spark, d), lo=-24.0, hi=150.0))


@query(
    "b06_negative_prices",
    sql(
        """SELECT zone, count(*) FILTER (WHERE price_eur_mwh < 0) AS n_negative,
  avg(CASE WHEN price_eur_mwh < 0 THEN 1e0 ELSE 0e0 END) * 100 AS negative_pct
FROM p GROUP BY zone""",
        "p",
        "negative_pct",
    ),
)
def _(spark, d):
    report = screen.price_screen(market.prices(spark, d))
    return rounded(report.select("zone", "n_negative", "negative_pct"))


@query(
    "b07_season_filter",
    sql(
        """SELECT zone, 'spring' AS season, count(*) AS n, avg(mae) AS mean_mae FROM eh
WHERE month(ts_utc) IN (3, 4, 5) GROUP BY zone
UNION ALL SELECT zone, 'summer', count(*), avg(mae) FROM eh
WHERE month(ts_utc) IN (6, 7, 8) GROUP BY zone""",
        "eh",
        "mean_mae",
    ),
)
def _(spark, d):
    out = None
    for season in screen.SEASONS:
        part = (
            screen.in_season(market.error_history(spark, d), season)
            .groupBy("zone")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("mae").alias("mean_mae"))
            .withColumn("season", F.lit(season))
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(
    "b08_clip_to_quantiles",
    sql(
        """SELECT zone, ts_utc, greatest(lo, least(hi, price_eur_mwh)) AS clipped
FROM p JOIN (SELECT zone, quantile_cont(price_eur_mwh, 0.001) AS lo,
                    quantile_cont(price_eur_mwh, 0.999) AS hi FROM p GROUP BY zone) USING (zone)""",
        "p",
        "clipped",
        places=9,
    ),
)
def _(spark, d):
    return rounded(
        screen.clip_to_quantiles(market.prices(spark, d), PRICE).select(
            "zone", "ts_utc", "clipped"
        ),
        places=9,
    )


@query(
    "b09_wind_total",
    sql(
        """SELECT zone, ts_utc, coalesce(wind_onshore_mw, 0) + coalesce(wind_offshore_mw, 0)
  AS wind_total_mw FROM ws""",
        "ws",
        "wind_total_mw",
    ),
)
def _(spark, d):
    rows = screen.with_wind_total(market.wind_solar(spark, d))
    return rounded(rows.select("zone", "ts_utc", "wind_total_mw"))


@query(
    "b10_attribute_with_default",
    sql(
        """SELECT zone, coalesce(annual_cost, 30000e0) AS annual_cost, n_hours
FROM (SELECT zone, count(*) AS n_hours FROM p GROUP BY zone) LEFT JOIN dim USING (zone)""",
        "p dim",
    ),
)
def _(spark, d):
    hours = market.prices(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("n_hours"))
    return screen.with_attribute(hours, market.zone_dim(spark), "zone", "annual_cost", 30000.0)


@query(
    "b11_calendar_parts",
    sql(
        """SELECT zone, ts_utc, price_eur_mwh, CAST(hour(t) AS INTEGER) AS hour,
  CAST(isodow(t) - 1 AS INTEGER) AS weekday, CAST(month(t) AS INTEGER) AS month,
  CAST(t AS DATE) AS local_date
FROM (SELECT *, ts_utc + INTERVAL 1 HOUR AS t FROM p)""",
        "p",
    ),
)
def _(spark, d):
    return screen.calendar_parts(market.prices(spark, d))
