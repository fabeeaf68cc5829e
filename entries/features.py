"""Feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, grid, registry, rounded, sql
from tidegrid.functions import time as T
from tidegrid.operators import features
from tidegrid.sources import dims
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()

_LAGS = """(SELECT zone, ts_utc, price_eur_mwh,
  lag(price_eur_mwh, 24) OVER w AS price_lag_1d,
  lag(price_eur_mwh, 48) OVER w AS price_lag_2d,
  lag(price_eur_mwh, 168) OVER w AS price_lag_7d,
  CASE WHEN count(price_eur_mwh) OVER wk >= 24 THEN avg(price_eur_mwh) OVER wk END
    AS price_rolling_7d_mean,
  CASE WHEN count(price_eur_mwh) OVER wk >= 24 THEN stddev_samp(price_eur_mwh) OVER wk END
    AS price_rolling_7d_std,
  CASE WHEN count(price_eur_mwh) OVER dy >= 24 THEN min(price_eur_mwh) OVER dy END
    AS price_rolling_24h_min,
  CASE WHEN count(price_eur_mwh) OVER dy >= 24 THEN max(price_eur_mwh) OVER dy END
    AS price_rolling_24h_max
FROM g WINDOW w AS (PARTITION BY zone ORDER BY ts_utc),
  wk AS (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 191 PRECEDING AND 24 PRECEDING),
  dy AS (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING))"""


@query(
    "e01_e03_price_lags",
    sql(f"SELECT zone, ts_utc, price_lag_1d, price_lag_2d, price_lag_7d FROM {_LAGS}", "g"),
)
def _(spark, d):
    made = features.lag_features(grid(spark, d))
    return made.select("zone", "ts_utc", "price_lag_1d", "price_lag_2d", "price_lag_7d")


@query(
    "e04_e07_rolling_prices",
    sql(
        f"""SELECT zone, ts_utc, price_rolling_7d_mean, price_rolling_7d_std, price_rolling_24h_min,
  price_rolling_24h_max FROM {_LAGS}""",
        "g",
        "price_rolling_7d_mean price_rolling_7d_std",
        places=9,
    ),
)
def _(spark, d):
    made = features.lag_features(grid(spark, d)).select(
        "zone", "ts_utc", "price_rolling_7d_mean", "price_rolling_7d_std",
        "price_rolling_24h_min", "price_rolling_24h_max",
    )
    return rounded(made, "price_rolling_7d_mean", "price_rolling_7d_std", places=9)


@query(
    "e08_e09_calendar",
    sql(
        """SELECT zone, ts_utc, sin(hour(t) * (2 * pi()) / 24) AS hour_sin,
  cos(hour(t) * (2 * pi()) / 24) AS hour_cos, sin((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_sin,
  cos((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_cos, isodow(t) >= 6 AS is_weekend
FROM (SELECT *, ts_utc + INTERVAL 1 HOUR AS t FROM p)""",
        "p",
        "hour_sin hour_cos weekday_sin weekday_cos",
    ),
)
def _(spark, d):
    made = features.calendar_features(market.prices(spark, d).select("zone", "ts_utc"))
    return rounded(made.drop("is_holiday"))


# Gregorian Easter in integer SQL
_EASTER = """(SELECT y, make_date(y, s // 31, s % 31 + 1) AS easter FROM (
  SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM (
    SELECT y, a, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
      SELECT y, a, b, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
        SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders))))))"""


@query(
    "e10_holidays",
    f"""SELECT o.d AS date, month(o.d) * 100 + day(o.d) IN (101, 1225, 1226)
    OR date_diff('day', easter, o.d) IN (-3, -2, 0, 1, 39, 49, 50)
    OR (date_diff('day', easter, o.d) = 26 AND y <= 2023) AS is_holiday
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) o
JOIN {_EASTER} e ON e.y = year(o.d)""",
)
def _(spark, d):
    days = market.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return days.distinct().withColumn("is_holiday", T.is_danish_holiday("date"))


@query(
    "e10_holiday_dimension",
    sql(
        """SELECT zone, ts_utc, CAST(ts_utc + INTERVAL 1 HOUR AS DATE)
  IN (SELECT DISTINCT CAST(o_orderdate AS DATE) + 9497 FROM orders)
  AS is_holiday FROM p""",
        "p",
    ),
)
def _(spark, d):
    shifted = F.date_add(F.col("o_orderdate").cast("date"), 9497)
    dim = market.table(spark, d, "orders").select(F.lit("DK").alias("country"), shifted.alias("date"))
    made = features.calendar_features(
        market.prices(spark, d).select("zone", "ts_utc"), holidays=dim
    )
    return made.select("zone", "ts_utc", "is_holiday")


_WIND_TOTAL = "coalesce(wind_onshore_mw, 0) + coalesce(wind_offshore_mw, 0)"


@query(
    "e11_residual_load",
    sql(
        f"""SELECT zone, ts_utc, load_mw, wind_mw, solar_mw, load_mw - wind_mw - solar_mw
  AS residual_load_mw
FROM l LEFT JOIN (SELECT zone, ts_utc, {_WIND_TOTAL} AS wind_mw, solar_mw FROM ws)
  USING (zone, ts_utc)""",
        "l ws",
        "load_mw wind_mw solar_mw residual_load_mw",
    ),
)
def _(spark, d):
    return rounded(features.residual_load(market.load(spark, d), market.wind_solar(spark, d)))


_WIND = f"""(SELECT *, lag(wind_actual_mw - wind_total_mw, 24) OVER (PARTITION BY zone ORDER BY ts_utc)
    AS wind_forecast_error_lag1,
  CASE WHEN count(wind_total_mw) OVER w >= 24 AND max(wind_total_mw) OVER w > 0
       THEN wind_total_mw / max(wind_total_mw) OVER w ELSE 0 END AS wind_capacity_factor
FROM (SELECT hrs.zone, hrs.ts_utc, {_WIND_TOTAL} AS wind_total_mw, wind_actual_mw, solar_mw,
        ws.zone IS NOT NULL AS has_row
      FROM hrs LEFT JOIN ws USING (zone, ts_utc) LEFT JOIN act USING (zone, ts_utc))
WINDOW w AS (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))"""
_WIND = _WIND.replace(
    f"{_WIND_TOTAL} AS wind_total_mw", f"CASE WHEN ws.zone IS NOT NULL THEN {_WIND_TOTAL} END AS wind_total_mw"
)


@query(
    "e12_wind_capacity_factor",
    sql(
        f"SELECT zone, ts_utc, wind_total_mw, wind_capacity_factor FROM {_WIND} WHERE has_row",
        "hrs ws act",
        "wind_total_mw wind_capacity_factor",
    ),
)
def _(spark, d):
    made = features.wind_features(market.wind_solar(spark, d))
    return rounded(made.drop("wind_forecast_error_lag1"))


@query(
    "e13_wind_forecast_error",
    sql(
        f"SELECT zone, ts_utc, wind_forecast_error_lag1 FROM {_WIND} WHERE has_row",
        "hrs ws act",
        "wind_forecast_error_lag1",
    ),
)
def _(spark, d):
    made = features.wind_features(market.wind_solar(spark, d), market.actuals(spark, d))
    return rounded(made.select("zone", "ts_utc", "wind_forecast_error_lag1"))


_FLOWS = """(SELECT e.from_zone, e.to_zone, capacity_mw, a.h AS ts_utc, (a.c - b.c) / 100e0 AS flow_mw
FROM edges e
JOIN (SELECT zone, h, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1, 2) a ON a.zone = e.from_zone
JOIN (SELECT zone, h, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1, 2) b
  ON b.zone = e.to_zone AND b.h = a.h)"""


@query(
    "e14_flow_utilisation",
    sql(
        f"""SELECT from_zone, to_zone, ts_utc, flow_mw, abs(flow_mw) / capacity_mw * 100 AS util_pct
FROM {_FLOWS}""",
        "ev edges",
        "util_pct",
    ),
)
def _(spark, d):
    made = features.flow_features(market.flows(spark, d), market.edges(spark))
    return rounded(made, "util_pct")


def _matrix_sql(extra: str = "") -> str:
    return f"""SELECT x.zone, x.ts_utc, price_eur_mwh, price_lag_1d, price_lag_2d, price_lag_7d,
  price_rolling_7d_mean, price_rolling_7d_std, price_rolling_24h_min, price_rolling_24h_max,
  sin(hour(t) * (2 * pi()) / 24) AS hour_sin, cos(hour(t) * (2 * pi()) / 24) AS hour_cos,
  sin((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_sin,
  cos((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_cos, isodow(t) >= 6 AS is_weekend,
  CAST(t AS DATE) = DATE '2024-01-01' AS is_holiday,
  load_mw - wind_total_mw - solar_mw AS residual_load_mw, load_mw, wind_total_mw,
  wind_capacity_factor, {extra} solar_mw
FROM (SELECT *, ts_utc + INTERVAL 1 HOUR AS t FROM {_LAGS} WHERE price_eur_mwh IS NOT NULL) x
LEFT JOIN (SELECT * FROM {_WIND} WHERE has_row) USING (zone, ts_utc)
LEFT JOIN l USING (zone, ts_utc)"""


_MATRIX_DOUBLES = (
    "price_rolling_7d_mean price_rolling_7d_std hour_sin hour_cos weekday_sin weekday_cos "
    "residual_load_mw load_mw wind_total_mw wind_capacity_factor solar_mw"
)


@query(
    "e15_feature_matrix",
    sql(_matrix_sql(), "g hrs ws act l", _MATRIX_DOUBLES, places=9),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d), market.load(spark, d), market.wind_solar(spark, d)
    )
    return rounded(matrix, *_MATRIX_DOUBLES.split(), places=9)


@query(
    "e15_feature_matrix_with_actuals_and_flows",
    sql(
        f"""SELECT m.*, f.flow_mw AS flow_click_view_mw,
  abs(f.flow_mw) / f.capacity_mw * 100 AS util_click_view_pct
FROM ({_matrix_sql("wind_forecast_error_lag1,")}) m
LEFT JOIN (SELECT * FROM {_FLOWS} WHERE from_zone = 'click') f ON f.ts_utc = m.ts_utc""",
        "g hrs ws act l edges",
        _MATRIX_DOUBLES + " wind_forecast_error_lag1 util_click_view_pct",
        places=9,
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d),
        market.load(spark, d),
        market.wind_solar(spark, d),
        actuals=market.actuals(spark, d),
        flows=market.flows(spark, d),
        edges=market.edges(spark),
        flow_labels=[("click", "view")],
    )
    names = _MATRIX_DOUBLES.split() + ["wind_forecast_error_lag1", "util_click_view_pct"]
    return rounded(matrix, *names, places=9)


@query(
    "e15_price_only_matrix",
    sql(
        f"""SELECT zone, ts_utc, price_eur_mwh, price_lag_1d, price_lag_2d, price_lag_7d,
  price_rolling_7d_mean, price_rolling_7d_std, price_rolling_24h_min, price_rolling_24h_max,
  sin(hour(t) * (2 * pi()) / 24) AS hour_sin, cos(hour(t) * (2 * pi()) / 24) AS hour_cos,
  sin((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_sin,
  cos((isodow(t) - 1) * (2 * pi()) / 7) AS weekday_cos, isodow(t) >= 6 AS is_weekend,
  CAST(t AS DATE) = DATE '2024-01-01' AS is_holiday
FROM (SELECT *, ts_utc + INTERVAL 1 HOUR AS t FROM {_LAGS} WHERE price_eur_mwh IS NOT NULL)""",
        "g",
        "price_rolling_7d_mean price_rolling_7d_std hour_sin hour_cos weekday_sin weekday_cos",
        places=9,
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(market.prices(spark, d))
    names = "price_rolling_7d_mean price_rolling_7d_std hour_sin hour_cos weekday_sin weekday_cos"
    return rounded(matrix, *names.split(), places=9)


_COMPLETE = """price_lag_1d IS NOT NULL AND price_lag_2d IS NOT NULL AND price_lag_7d IS NOT NULL
  AND price_rolling_7d_std IS NOT NULL AND price_rolling_24h_min IS NOT NULL"""


@query(
    "e15_warm_up",
    sql(
        f"""SELECT zone, count(*) AS rows_before, count(*) FILTER (WHERE {_COMPLETE}) AS rows_after,
  count(*) - count(*) FILTER (WHERE {_COMPLETE}) AS dropped
FROM {_LAGS} WHERE price_eur_mwh IS NOT NULL GROUP BY zone""",
        "g",
    ),
)
def _(spark, d):
    inputs = market.prices(spark, d), market.load(spark, d), market.wind_solar(spark, d)
    full = features.feature_matrix(*inputs)
    return features.warm_up(full, features.feature_matrix(*inputs, complete=True))


@query(
    "e15_complete_matrix",
    sql(
        f"""SELECT zone, ts_utc, price_eur_mwh, price_lag_7d FROM {_LAGS}
WHERE price_eur_mwh IS NOT NULL AND {_COMPLETE}""",
        "g",
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d), market.load(spark, d), market.wind_solar(spark, d), complete=True
    )
    return matrix.select("zone", "ts_utc", PRICE, "price_lag_7d")


@query(
    "e15_model_rows",
    sql(
        f"""SELECT zone, ts_utc, price_eur_mwh FROM {_LAGS}
WHERE price_eur_mwh IS NOT NULL AND {_COMPLETE}""",
        "g",
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d), market.load(spark, d), market.wind_solar(spark, d),
    )
    return features.model_rows(matrix).select("zone", "ts_utc", PRICE)


@query(
    "e16_gate_closure",
    sql(
        f"SELECT zone, ts_utc, price_lag_2d, price_lag_7d FROM {_LAGS}",
        "g",
    ),
)
def _(spark, d):
    made = features.gate_closure_features(features.lag_features(grid(spark, d)))
    kept = [c for c in features.FEATURE_AVAILABILITY if c in made.columns]
    return made.select("zone", "ts_utc", *kept)


_KNOWN = (
    "price_lag_2d price_lag_7d hour_sin hour_cos weekday_sin weekday_cos is_weekend is_holiday "
    "residual_load_mw load_mw wind_total_mw wind_capacity_factor solar_mw"
)


@query(
    "e16_gate_closure_of_the_full_matrix",
    sql(
        f"""SELECT zone, ts_utc, price_eur_mwh, {_KNOWN.replace(" ", ", ")}
FROM ({_matrix_sql("wind_forecast_error_lag1,")}) m""",
        "g hrs ws act l",
        "hour_sin hour_cos weekday_sin weekday_cos residual_load_mw load_mw wind_total_mw "
        "wind_capacity_factor solar_mw",
        places=9,
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d), market.load(spark, d), market.wind_solar(spark, d),
        actuals=market.actuals(spark, d), flows=market.flows(spark, d), edges=market.edges(spark),
        flow_labels=[("click", "view")],
    )
    names = [c for c in _MATRIX_DOUBLES.split() if "rolling" not in c]
    return rounded(features.gate_closure_features(matrix), *names, places=9)


_AVAILABLE = ", ".join(
    f"('{n}', '{w}')" for n, w in features.FEATURE_AVAILABILITY.items()
)


@query(
    "e16_availability_rule",
    sql(
        f"""SELECT zone, feature, available_from = 'always'
    OR CAST(regexp_extract(available_from, '^D-([0-9]+)', 1) AS VARCHAR) > '1'
    OR (available_from LIKE 'D-1 %:%' AND substr(available_from, 5, 5) <= '12:00') AS known,
  n_hours
FROM (VALUES {_AVAILABLE}) f(feature, available_from)
CROSS JOIN (SELECT zone, count(*) AS n_hours FROM p GROUP BY zone)""",
        "p",
    ),
)
def _(spark, d):
    hours = market.prices(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("n_hours"))
    rules = dims.feature_availability(spark).select(
        "feature", features.known_at_gate("available_from").alias("known")
    )
    listed = F.array(*[F.lit(n) for n in features.FEATURE_AVAILABILITY])
    return hours.withColumn("feature", F.explode(listed)).join(rules, "feature")


@query("e17_similar_day", sql("SELECT zone, ts_utc, baseline FROM base", "base"))
def _(spark, d):
    return features.similar_day(grid(spark, d)).select("zone", "ts_utc", "baseline")


@query(
    "e18_rolling_volatility",
    sql(
        """SELECT zone, ts_utc, CASE WHEN count(price_eur_mwh) OVER w >= 24
  THEN stddev_samp(price_eur_mwh) OVER w END AS rolling_7d_std
FROM g WINDOW w AS (PARTITION BY zone ORDER BY ts_utc ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
        "g",
        "rolling_7d_std",
    ),
)
def _(spark, d):
    made = features.rolling_volatility(grid(spark, d))
    return rounded(made.select("zone", "ts_utc", "rolling_7d_std"))


def pearson_sql(a: str, b: str) -> str:
    both = f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return (
        f"covar_samp({a}, {b}) / nullif((stddev_samp({a}) FILTER ({both})) * "
        f"(stddev_samp({b}) FILTER ({both})), 0)"
    )


@query(
    "e19_look_ahead_demo",
    sql(
        f"""SELECT zone, r_1h, r_24h, (r_1h / nullif(r_24h, 0) - 1) * 100 AS inflation_pct FROM (
  SELECT zone, {pearson_sql("x", "y1")} AS r_1h, {pearson_sql("x", "y24")} AS r_24h
  FROM (SELECT zone, price_eur_mwh AS x, lag(price_eur_mwh, 1) OVER w AS y1,
          lag(price_eur_mwh, 24) OVER w AS y24
        FROM g WINDOW w AS (PARTITION BY zone ORDER BY ts_utc)) GROUP BY zone)""",
        "g",
        "r_1h r_24h inflation_pct",
    ),
)
def _(spark, d):
    return rounded(features.look_ahead_demo(grid(spark, d)))


@query(
    "e15_user_zones_feature_matrix",
    sql(_matrix_sql(), "g hrs ws act l", _MATRIX_DOUBLES, places=9).replace(
        "event_type AS zone", "CAST(user_id AS VARCHAR) AS zone"
    ),
)
def _(spark, d):
    matrix = features.feature_matrix(
        market.prices(spark, d, "user_id"),
        market.load(spark, d, "user_id"),
        market.wind_solar(spark, d, "user_id"),
    )
    return rounded(matrix, *_MATRIX_DOUBLES.split(), places=9)
