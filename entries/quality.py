"""Imputation, completeness, rule checks and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, WIND, registry, rounded, sql
from tidegrid.functions import time as T
from tidegrid.operators import quality
from tidegrid.operators.screen import calendar_parts
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()


def _filled(alias: str) -> str:
    """Limited forward fill of the three generation columns of a relation."""
    cols = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS f_{c}, {c} IS NULL AS n_{c}" for c in WIND
    )
    return f"""(SELECT zone, ts_utc, {cols} FROM {alias}
  WINDOW w AS (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


_AUDIT = " UNION ALL ".join(
    f"SELECT zone, 'wind_solar' AS datatype, '{c}' AS \"column\", ts_utc, 'ffill (max 6h)' AS method "
    f"FROM {_filled('ws')} WHERE n_{c} AND f_{c} IS NOT NULL"
    for c in WIND
)


@query(
    "d01_limited_forward_fill",
    sql(
        "SELECT zone, ts_utc, " + ", ".join(f"f_{c} AS {c}" for c in WIND)
        + f" FROM {_filled('ws')}",
        "ws",
    ),
)
def _(spark, d):
    return quality.impute_ffill(market.wind_solar(spark, d), WIND)[0]


@query("d02_imputation_audit", sql(_AUDIT, "ws"))
def _(spark, d):
    return quality.impute_ffill(market.wind_solar(spark, d), WIND, datatype="wind_solar")[1]


@query(
    "d03_audit_top_counts",
    sql(
        f"""SELECT datatype, "column", count(*) AS n_imputed FROM ({_AUDIT})
GROUP BY datatype, "column" ORDER BY n_imputed DESC, datatype, "column" LIMIT 5""",
        "ws",
    ),
)
def _(spark, d):
    audit = quality.impute_ffill(market.wind_solar(spark, d), WIND, datatype="wind_solar")[1]
    return quality.audit_counts(audit, top=5)


def _landed(df, *extra):
    """Each hourly row landed twice; the second copy has a later ingest number
    and no values, so keep-first decides."""
    values = [c for c in df.columns if c not in ("zone", "ts_utc")]
    first = df.withColumn("ingest_no", F.lit(1))
    second = df.select(
        "zone", "ts_utc", *[F.lit(None).cast("double").alias(c) for c in values],
        F.lit(2).alias("ingest_no"),
    )
    return first.unionByName(second)


def _loaded(spark, d):
    return quality.load_all(
        {
            "prices": (_landed(market.prices(spark, d)), [PRICE]),
            "wind_solar": (_landed(market.wind_solar(spark, d)), WIND),
            "load": (_landed(market.load(spark, d)), ["load_mw"]),
        }
    )


@query(
    "d04_load_all_wind_solar",
    sql(
        "SELECT zone, ts_utc, " + ", ".join(f"f_{c} AS {c}" for c in WIND)
        + f" FROM {_filled('ws')} WHERE "
        + " AND ".join(f"f_{c} IS NOT NULL" for c in WIND),
        "ws",
    ),
)
def _(spark, d):
    return _loaded(spark, d)["wind_solar"]


@query("d04_load_all_load", sql("SELECT * FROM l SEMI JOIN p USING (zone, ts_utc)", "l p"))
def _(spark, d):
    return _loaded(spark, d)["load"]


@query(
    "d04_load_all_imputation_log",
    sql(f"SELECT zone, \"column\", count(*) AS n FROM ({_AUDIT}) GROUP BY ALL", "ws"),
)
def _(spark, d):
    log = _loaded(spark, d)["imputation_log"]
    return log.groupBy("zone", "column").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d05_quality_rules",
    sql(
        """SELECT 'load' AS dataset, zone, 'quality_flag' AS "column", 'missing' AS error,
  count(*) AS n_rows FROM ev GROUP BY zone
UNION ALL SELECT 'load', zone, 'load_mw', 'wrong_type', count(*) FROM ev WHERE k < 10 GROUP BY zone
UNION ALL SELECT 'load', zone, 'comment', 'empty', count(*) FROM ev GROUP BY zone""",
        "ev",
    ),
)
def _(spark, d):
    landed = market.events(spark, d).select(
        "zone",
        F.when(market.share_key() < 10, "n/e").otherwise(F.col("value").cast("string")).alias(
            "load_mw"
        ),
        F.lit(None).cast("string").alias("comment"),
        "event_id",
    )
    rules = {"load_mw": "float", "comment": "any", "event_id": "int", "quality_flag": "any"}
    return quality.quality_rules(landed, "load", rules)


@query(
    "d06_rule_presets",
    sql(
        """SELECT 'prices' AS dataset, zone, 'price_eur_mwh' AS "column", 'wrong_type' AS error,
  count(*) AS n_rows FROM ev WHERE k >= 90 GROUP BY zone
UNION ALL SELECT 'load', zone, 'load_mw', 'missing', count(*) FROM ev GROUP BY zone
UNION ALL SELECT 'wind_solar', zone, 'solar_mw', 'wrong_type', count(*) FROM ev
  WHERE k < 5 GROUP BY zone""",
        "ev",
    ),
)
def _(spark, d):
    k, text = market.share_key(), F.col("value").cast("string")
    landed = market.events(spark, d).select(
        "zone",
        F.when(k >= 90, "missing").otherwise(text).alias("price_eur_mwh"),
        F.when(k < 5, "-").otherwise(text).alias("solar_mw"),
    )
    out = None
    for dataset in quality.RULES:
        part = quality.quality_rules(landed, dataset)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "d07_timestamps_without_offset",
    sql(
        """SELECT zone, count(*) AS n_rows, count(*) FILTER (WHERE source = 'entsoe')
  AS n_without_offset FROM ev GROUP BY zone""",
        "ev",
    ),
)
def _(spark, d):
    naive = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamped = F.concat(naive, F.when(F.second("ts") < 15, "Z").otherwise("+01:00"))
    text = F.when(market.source_of() == "entsoe", naive).otherwise(stamped)
    landed = market.events(spark, d).select("zone", text.alias("ts_text"))
    return quality.naive_timestamps(landed, "ts_text")


@query(
    "d08_to_utc_and_local",
    sql(
        """SELECT event_id, ts AS ts_utc, ts + INTERVAL 1 HOUR AS ts_cet,
  ts - INTERVAL 1 HOUR AS cet_as_utc FROM ev""",
        "ev",
    ),
)
def _(spark, d):
    return market.events(spark, d).select(
        "event_id",
        F.col("ts").alias("ts_utc"),
        T.to_cet("ts").alias("ts_cet"),
        T.to_utc("ts", T.MARKET_TZ).alias("cet_as_utc"),
    )


_TRANSITIONS = """(SELECT y AS year, d AS date, type, hours FROM (
  SELECT y, last_day(make_date(y, 3, 1)) - CAST(isodow(last_day(make_date(y, 3, 1))) % 7 AS INTEGER)
    AS d, 'spring_forward' AS type, 23 AS hours FROM years
  UNION ALL
  SELECT y, last_day(make_date(y, 10, 1)) - CAST(isodow(last_day(make_date(y, 10, 1))) % 7 AS INTEGER),
    'fall_back', 25 FROM years))"""
_YEARS = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)"


@query("d09_dst_transitions", f"WITH {_YEARS} SELECT * FROM {_TRANSITIONS}")
def _(spark, d):
    years = market.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return quality.dst_transitions(years.distinct())


@query(
    "d10_expected_hours",
    f"""WITH {_YEARS}
SELECT o.date, coalesce(t.hours, 24) AS expected
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) o
LEFT JOIN {_TRANSITIONS} t ON t.date = o.date""",
)
def _(spark, d):
    days = market.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return days.distinct().withColumn("expected", T.expected_hours("date"))


@query(
    "d11_daily_completeness",
    sql(
        """SELECT zone, local_date, 24 AS expected, n AS actual, 24 - n AS missing, n >= 24 AS complete
FROM (SELECT zone, CAST(ts_utc + INTERVAL 1 HOUR AS DATE) AS local_date, count(*) AS n
      FROM p GROUP BY ALL)""",
        "p",
    ),
)
def _(spark, d):
    return quality.daily_completeness(market.prices(spark, d))


@query(
    "d12_dst_day_row_counts",
    f"""WITH {_YEARS}, daily AS (
  SELECT o_orderpriority AS zone, CAST(o_orderdate AS DATE) AS date, 1 AS n
  FROM orders GROUP BY 1, 2),
span AS (SELECT zone, min(date) AS lo, max(date) AS hi FROM daily GROUP BY zone)
SELECT span.zone, t.date, t.type, t.hours, CAST(coalesce(daily.n, 0) AS BIGINT) AS actual
FROM span JOIN {_TRANSITIONS} t ON t.date BETWEEN span.lo AND span.hi
LEFT JOIN daily ON daily.zone = span.zone AND daily.date = t.date
WHERE coalesce(daily.n, 0) <> t.hours""",
)
def _(spark, d):
    return quality.dst_day_errors(market.error_history(spark, d), "UTC")


@query(
    "d13_completeness_gate",
    sql(
        """SELECT zone, n AS actual_hours, days * 24 AS expected_hours,
  n / (days * 24e0) * 100 AS completeness_pct, n / (days * 24e0) * 100 >= 90 AS passes
FROM (SELECT zone, count(*) AS n,
        CAST(floor(date_diff('hour', min(ts_utc), max(ts_utc)) / 24) AS BIGINT) + 1 AS days
      FROM p GROUP BY zone)""",
        "p",
        "completeness_pct",
    ),
)
def _(spark, d):
    return rounded(quality.completeness(market.prices(spark, d)))


@query(
    "d14_hourly_coverage",
    sql(
        """SELECT zone, count(wind_onshore_mw) AS covered_hours,
  date_diff('hour', min(ts_utc), max(ts_utc)) + 1 AS grid_hours,
  least(100e0, count(wind_onshore_mw) * 100e0 / (date_diff('hour', min(ts_utc), max(ts_utc)) + 1))
    AS coverage_pct FROM ws GROUP BY zone""",
        "ws",
        "coverage_pct",
    ),
)
def _(spark, d):
    return rounded(quality.hourly_coverage(market.wind_solar(spark, d), "wind_onshore_mw"))


@query(
    "d15_imputation_gate",
    sql(
        f"""SELECT zone, n_hours, coalesce(n_imputed, 0) AS n_imputed,
  coalesce(n_imputed, 0) * 100e0 / n_hours AS imputed_pct,
  coalesce(n_imputed, 0) * 100e0 / n_hours > 5 AS warns
FROM (SELECT zone, count(*) AS n_hours FROM p GROUP BY zone)
LEFT JOIN (SELECT zone, count(*) AS n_imputed FROM ({_AUDIT}) GROUP BY zone) USING (zone)""",
        "p ws",
        "imputed_pct",
    ),
)
def _(spark, d):
    audit = quality.impute_ffill(market.wind_solar(spark, d), WIND)[1]
    return rounded(quality.imputation_gate(market.prices(spark, d), audit))


_OUTLIERS = """(SELECT zone, ts_utc, price_eur_mwh, rolling_mean, rolling_std,
  (price_eur_mwh - rolling_mean) / rolling_std AS z_score
FROM (SELECT *, CASE WHEN n >= 24 THEN m END AS rolling_mean,
             CASE WHEN n >= 24 THEN nullif(s, 0) END AS rolling_std
      FROM (SELECT *, count(price_eur_mwh) OVER w AS n, avg(price_eur_mwh) OVER w AS m,
              stddev_samp(price_eur_mwh) OVER w AS s
            FROM p WINDOW w AS (PARTITION BY zone ORDER BY ts_utc
                                ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))))"""


@query(
    "d16_outliers",
    sql(
        f"""SELECT *, price_eur_mwh > 100 OR coalesce(z_score > 3, false) AS is_outlier,
  CASE WHEN price_eur_mwh > 100 THEN 'Extreme high spike: > 100.0 EUR/MWh'
       WHEN z_score > 3 THEN 'Positive spike: z-score > 3.0' ELSE '' END AS reason
FROM {_OUTLIERS}""",
        "p",
        "rolling_mean rolling_std z_score",
        places=9,
    ),
)
def _(spark, d):
    flagged = quality.detect_outliers(market.prices(spark, d), extreme_high_threshold=100.0)
    return rounded(flagged, "rolling_mean", "rolling_std", "z_score", places=9)


def _zone_quality(spark, d):
    audit = quality.impute_ffill(market.wind_solar(spark, d), WIND)[1]
    return quality.zone_quality(
        market.prices(spark, d), market.wind_solar(spark, d), market.load(spark, d), audit
    )


@query(
    "d17_zone_quality",
    sql(
        f"""SELECT zone, CAST(n / (days * 24e0) * 100 < 90 AS INTEGER) AS n_errors,
  CAST((missing > 0)::INTEGER * 2 + (n_out > 10)::INTEGER
    + (coalesce(n_imp, 0) * 100e0 / n > 5)::INTEGER AS INTEGER) AS n_warnings,
  n / (days * 24e0) * 100 < 90 AS skip
FROM (SELECT zone, count(*) AS n, date_diff('hour', min(ts_utc), max(ts_utc)) + 1 - count(*)
        AS missing, floor(date_diff('hour', min(ts_utc), max(ts_utc)) / 24) + 1 AS days
      FROM p GROUP BY zone)
JOIN (SELECT zone, count(*) FILTER (WHERE price_eur_mwh > 500 OR z_score > 3) AS n_out
      FROM {_OUTLIERS} GROUP BY zone) USING (zone)
LEFT JOIN (SELECT zone, count(*) AS n_imp FROM ({_AUDIT}) GROUP BY zone) USING (zone)""",
        "p ws",
    ),
)
def _(spark, d):
    return _zone_quality(spark, d).select(
        "zone", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "skip"
    )


@query("d17_zone_quality_messages")
def _(spark, d):
    return _zone_quality(spark, d)


@query(
    "d17_passing_zones",
    sql(
        """SELECT zone, month, count(*) AS n_hours FROM (
  SELECT zone, CAST(month(ts_utc + INTERVAL 1 HOUR) AS INTEGER) AS month, count(*) OVER z AS n,
    floor(date_diff('hour', min(ts_utc) OVER z, max(ts_utc) OVER z) / 24) + 1 AS days
  FROM p WINDOW z AS (PARTITION BY zone))
WHERE n / (days * 24e0) * 100 >= 90 GROUP BY zone, month""",
        "p",
    ),
)
def _(spark, d):
    prices = market.prices(spark, d)
    kept = quality.passing_zones(prices, _zone_quality(spark, d))
    return calendar_parts(kept).groupBy("zone", "month").agg(F.count(F.lit(1)).alias("n_hours"))
