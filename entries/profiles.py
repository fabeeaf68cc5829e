"""Profiles, correlations, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, grid, predictions, registry, rounded, sql
from entries.features import pearson_sql
from tidegrid.operators import features, profiles
from tidegrid.operators.align import inner_align
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()

_LOCAL = "(SELECT *, ts_utc + INTERVAL 1 HOUR AS t FROM p)"
_PARTS = {
    "hour": "CAST(hour(t) AS INTEGER)",
    "weekday": "CAST(isodow(t) - 1 AS INTEGER)",
    "month": "CAST(month(t) AS INTEGER)",
}


def _profile(part: str):
    @query(
        f"f01_profile_by_{part}",
        sql(
            f"""SELECT zone, {_PARTS[part]} AS {part}, avg(price_eur_mwh) AS mean_price_eur_mwh
FROM {_LOCAL} GROUP BY 1, 2""",
            "p",
            "mean_price_eur_mwh",
        ),
    )
    def _(spark, d):
        return rounded(profiles.profile_by(market.prices(spark, d), part))


for _part in _PARTS:
    _profile(_part)


@query(
    "f02_box_stats_by_hour",
    sql(
        """SELECT zone, hour, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median,
  any_value(q3) AS q3, min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
  max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS whisker_hi
FROM (SELECT zone, CAST(hour(ts_utc + INTERVAL 1 HOUR) AS INTEGER) AS hour, price_eur_mwh AS x
      FROM p)
JOIN (SELECT zone, CAST(hour(ts_utc + INTERVAL 1 HOUR) AS INTEGER) AS hour,
        quantile_cont(price_eur_mwh, 0.25) AS q1, quantile_cont(price_eur_mwh, 0.5) AS median,
        quantile_cont(price_eur_mwh, 0.75) AS q3 FROM p GROUP BY 1, 2) USING (zone, hour)
GROUP BY zone, hour""",
        "p",
        "q1 median q3 whisker_lo whisker_hi",
        places=9,
    ),
)
def _(spark, d):
    return rounded(profiles.box_stats(market.prices(spark, d)), places=9)


@query(
    "f03_daily_mean",
    sql(
        f"""SELECT zone, CAST(t AS DATE) AS period, avg(price_eur_mwh) AS mean_value
FROM {_LOCAL} GROUP BY 1, 2""",
        "p",
        "mean_value",
    ),
)
def _(spark, d):
    return rounded(profiles.resample_mean(market.prices(spark, d), "day"))


@query(
    "f03_weekly_mean",
    sql(
        f"""SELECT zone, CAST(date_trunc('week', t) AS DATE) + 6 AS period,
  avg(price_eur_mwh) AS mean_value FROM {_LOCAL} GROUP BY 1, 2""",
        "p",
        "mean_value",
    ),
)
def _(spark, d):
    return rounded(profiles.resample_mean(market.prices(spark, d), "week"))


_DESCRIBE = """count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min,
  quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75,
  max({x}) AS max"""


@query(
    "f04_describe",
    sql(
        f"SELECT zone, {_DESCRIBE.format(x='price_eur_mwh')} FROM p GROUP BY zone",
        "p",
        "mean std min p25 p50 p75 max",
    ),
)
def _(spark, d):
    return rounded(profiles.describe(market.prices(spark, d), PRICE))


@query(
    "f04_describe_all_line_items",
    f"SELECT * REPLACE (round(mean, 6) + 0 AS mean, round(std, 6) + 0 AS std, "
    f"round(p25, 6) + 0 AS p25, round(p50, 6) + 0 AS p50, round(p75, 6) + 0 AS p75) FROM ("
    f"SELECT {_DESCRIBE.format(x='l_extendedprice')} FROM lineitem)",
)
def _(spark, d):
    described = profiles.describe(market.table(spark, d, "lineitem"), "l_extendedprice", by=())
    return rounded(described, "mean", "std", "p25", "p50", "p75")


_FUNDAMENTALS = ["load_mw", "wind_total_mw", "solar_mw", "residual_load_mw"]
_JOINED = """(SELECT zone, ts_utc, price_eur_mwh, load_mw,
  coalesce(wind_onshore_mw, 0) + coalesce(wind_offshore_mw, 0) AS wind_total_mw, solar_mw,
  load_mw - (coalesce(wind_onshore_mw, 0) + coalesce(wind_offshore_mw, 0)) - solar_mw
    AS residual_load_mw
FROM p JOIN l USING (zone, ts_utc) JOIN ws USING (zone, ts_utc))"""


def _joined(spark, d):
    residual = features.residual_load(market.load(spark, d), market.wind_solar(spark, d))
    return inner_align(
        market.prices(spark, d), residual.withColumnRenamed("wind_mw", "wind_total_mw")
    )


@query(
    "f05_correlation_with_price",
    sql(
        " UNION ALL ".join(
            f"""SELECT zone, '{c}' AS "column", {pearson_sql("price_eur_mwh", c)} AS r
FROM {_JOINED} GROUP BY zone"""
            for c in _FUNDAMENTALS
        ),
        "p l ws",
        "r",
    ),
)
def _(spark, d):
    return rounded(profiles.correlation_with(_joined(spark, d), PRICE, _FUNDAMENTALS))


_MATRIX = [PRICE, *_FUNDAMENTALS]


@query(
    "f05_correlation_matrix",
    sql(
        " UNION ALL ".join(
            f"""SELECT zone, '{a}' AS column_a, '{b}' AS column_b, {pearson_sql(a, b)} AS r
FROM {_JOINED} GROUP BY zone"""
            for a in _MATRIX
            for b in _MATRIX
        ),
        "p l ws",
        "r",
    ),
)
def _(spark, d):
    return rounded(profiles.correlation_matrix(_joined(spark, d), _MATRIX))


_BOTH = """(SELECT from_zone AS zone, to_zone AS neighbour FROM edges
  UNION SELECT to_zone, from_zone FROM edges)"""


@query(
    "f06_lagged_cross_correlation",
    sql(
        "SELECT e.zone, e.neighbour, "
        + ", ".join(
            f"CASE WHEN count(*) FILTER (WHERE a.price_eur_mwh IS NOT NULL AND l{k} IS NOT NULL) "
            f"> 100 THEN {pearson_sql('a.price_eur_mwh', f'l{k}')} END AS lag_{k}h"
            for k in range(4)
        )
        + f""" FROM {_BOTH} e JOIN g a ON a.zone = e.zone
JOIN (SELECT zone, ts_utc, price_eur_mwh AS l0, lag(price_eur_mwh, 1) OVER w AS l1,
        lag(price_eur_mwh, 2) OVER w AS l2, lag(price_eur_mwh, 3) OVER w AS l3
      FROM g WINDOW w AS (PARTITION BY zone ORDER BY ts_utc)) b
  ON b.zone = e.neighbour AND b.ts_utc = a.ts_utc
GROUP BY e.zone, e.neighbour""",
        "g edges",
        "lag_0h lag_1h lag_2h lag_3h",
    ),
)
def _(spark, d):
    return rounded(profiles.lagged_cross_correlation(market.edges(spark), grid(spark, d)))


@query(
    "f07_autocorrelation",
    sql(
        f"""SELECT zone, lag_hours, {pearson_sql("x", "y")} AS r FROM (
  SELECT a.zone, CAST(k AS INTEGER) AS lag_hours, a.price_eur_mwh AS x, b.price_eur_mwh AS y
  FROM g a CROSS JOIN generate_series(1, 72) s(k)
  JOIN g b ON b.zone = a.zone AND b.ts_utc = a.ts_utc - to_hours(CAST(k AS INTEGER)))
GROUP BY zone, lag_hours""",
        "g",
        "r",
    ),
)
def _(spark, d):
    return rounded(profiles.autocorrelation(grid(spark, d)))


_EDGE = """(SELECT from_zone, to_zone, a.ts_utc, a.price_eur_mwh AS x, b.price_eur_mwh AS y,
  a.price_eur_mwh - b.price_eur_mwh AS spread
FROM edges JOIN p a ON a.zone = from_zone JOIN p b ON b.zone = to_zone AND b.ts_utc = a.ts_utc)"""


@query(
    "f08_adjacent_correlation",
    sql(
        f"""SELECT from_zone, to_zone, {pearson_sql("x", "y")} AS correlation, count(*) AS n_hours
FROM {_EDGE} GROUP BY from_zone, to_zone HAVING count(*) > 100
ORDER BY correlation DESC""",
        "p edges",
        "correlation",
    ),
)
def _(spark, d):
    pairs = profiles.adjacent_correlation(market.edges(spark), market.prices(spark, d))
    return rounded(pairs, "correlation").orderBy(F.desc("correlation"))


@query(
    "f09_spread_stats",
    sql(
        f"""SELECT from_zone, to_zone, count(*) AS n_hours, avg(spread) AS mean_spread,
  stddev_samp(spread) AS std_spread,
  avg(CASE WHEN spread > 0 THEN 1e0 ELSE 0e0 END) * 100 AS positive_pct,
  avg(CASE WHEN abs(spread) < 0.5 THEN 1e0 ELSE 0e0 END) * 100 AS identical_pct
FROM {_EDGE} GROUP BY from_zone, to_zone""",
        "p edges",
        "mean_spread std_spread positive_pct identical_pct",
    ),
)
def _(spark, d):
    return rounded(
        profiles.spread_stats(market.edges(spark), market.prices(spark, d), tolerance=0.5)
    )


@query(
    "f09_daily_spread",
    sql(
        f"""SELECT from_zone, to_zone, CAST(ts_utc + INTERVAL 1 HOUR AS DATE) AS period,
  avg(spread) AS mean_value FROM {_EDGE} GROUP BY 1, 2, 3""",
        "p edges",
        "mean_value",
    ),
)
def _(spark, d):
    return rounded(
        profiles.daily_spread(market.edges(spark), market.prices(spark, d), "Europe/Copenhagen")
    )


@query(
    "f10_binned_wind_price_curve",
    sql(
        f"""SELECT zone, CAST(bin AS BIGINT) AS bin,
  (CASE WHEN bin = 1 THEN any_value(lo) - (any_value(hi) - any_value(lo)) * 0.001e0
        ELSE any_value(lo) + any_value(w) * (bin - 1) END + any_value(lo) + any_value(w) * bin) / 2
    AS mid,
  avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS std, count(*) AS n
FROM (SELECT zone, y, lo, hi, (hi - lo) / 20 AS w,
        least(greatest(coalesce(ceil((x - lo) / nullif((hi - lo) / 20, 0)), 1), 1), 20) AS bin
      FROM (SELECT zone, wind_total_mw AS x, price_eur_mwh AS y,
              min(wind_total_mw) OVER (PARTITION BY zone) AS lo,
              max(wind_total_mw) OVER (PARTITION BY zone) AS hi FROM {_JOINED}))
GROUP BY zone, bin""",
        "p l ws",
        "mid mean median std",
        places=7,
    ),
)
def _(spark, d):
    return rounded(profiles.binned_curve(_joined(spark, d), "wind_total_mw", PRICE), places=7)


def _histogram_sql(relation: str, x: str, bins: int) -> str:
    return f"""SELECT zone, CAST(least(coalesce(floor((x - lo) / nullif((hi - lo) / {bins}, 0)) + 1, 1),
  {bins}) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT zone, {x} AS x, min({x}) OVER (PARTITION BY zone) AS lo,
        max({x}) OVER (PARTITION BY zone) AS hi FROM {relation}) GROUP BY 1, 2"""


_CLIPPED = """(SELECT zone, greatest(lo, least(hi, price_eur_mwh)) AS x
FROM p JOIN (SELECT zone, quantile_cont(price_eur_mwh, 0.001) AS lo,
                    quantile_cont(price_eur_mwh, 0.999) AS hi FROM p GROUP BY zone) USING (zone))"""


@query("f11_clipped_histogram", sql(_histogram_sql(_CLIPPED, "x", 100), "p"))
def _(spark, d):
    return profiles.clipped_histogram(market.prices(spark, d))


_TAIL = f"""(SELECT *, CASE WHEN price_eur_mwh <= lo THEN 'bottom' WHEN price_eur_mwh >= hi THEN 'top'
  ELSE 'middle' END AS segment
FROM {_JOINED} JOIN (SELECT zone, quantile_cont(price_eur_mwh, 0.01e0) AS lo,
  quantile_cont(price_eur_mwh, 0.99e0) AS hi FROM {_JOINED} GROUP BY zone) USING (zone))"""


@query(
    "f12_tail_conditions",
    sql(
        f"""SELECT zone, segment, count(*) AS n_hours, avg(price_eur_mwh) AS mean_price_eur_mwh,
  avg(wind_total_mw) AS mean_wind_total_mw, avg(solar_mw) AS mean_solar_mw,
  avg(load_mw) AS mean_load_mw, avg(residual_load_mw) AS mean_residual_load_mw
FROM {_TAIL} GROUP BY zone, segment""",
        "p l ws",
        "mean_price_eur_mwh mean_wind_total_mw mean_solar_mw mean_load_mw mean_residual_load_mw",
        places=8,
    ),
)
def _(spark, d):
    means = [PRICE, "wind_total_mw", "solar_mw", "load_mw", "residual_load_mw"]
    return rounded(profiles.tail_conditions(_joined(spark, d), means), places=8)


@query(
    "f12_tail_hours",
    sql(
        f"""SELECT zone, segment, CAST(hour(ts_utc + INTERVAL 1 HOUR) AS INTEGER) AS hour,
  count(*) AS n_hours FROM {_TAIL} WHERE segment <> 'middle' GROUP BY 1, 2, 3""",
        "p l ws",
    ),
)
def _(spark, d):
    return profiles.tail_hours(_joined(spark, d))


def _extreme(name: str, highest: bool):
    order = "DESC" if highest else "ASC"

    @query(
        name,
        sql(
            f"""SELECT zone, CAST(r AS INTEGER) AS rank, ts_utc, price_eur_mwh,
  {_PARTS["hour"]} AS hour, {_PARTS["weekday"]} AS weekday
FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY price_eur_mwh {order}, ts_utc) AS r
      FROM {_LOCAL}) WHERE r <= 10""",
            "p",
        ),
    )
    def _(spark, d):
        return profiles.extreme_hours(market.prices(spark, d), 10, highest)


_extreme("f13_highest_hours", True)
_extreme("f13_lowest_hours", False)


@query(
    "f14_hour_month_table",
    sql(
        "SELECT zone, CAST(hour(t) AS INTEGER) AS hour, "
        + ", ".join(f"avg(price_eur_mwh) FILTER (WHERE month(t) = {m}) AS m{m}" for m in range(1, 13))
        + f" FROM {_LOCAL} GROUP BY 1, 2",
        "p",
        " ".join(f"m{m}" for m in range(1, 13)),
    ),
)
def _(spark, d):
    return rounded(profiles.hour_month_table(market.prices(spark, d)))


@query(
    "f14_order_month_table",
    sql(
        "SELECT zone, CAST(hour(ts_utc) AS INTEGER) AS hour, "
        + ", ".join(f"avg(mae) FILTER (WHERE month(ts_utc) = {m}) AS m{m}" for m in range(1, 13))
        + " FROM eh GROUP BY 1, 2",
        "eh",
        " ".join(f"m{m}" for m in range(1, 13)),
    ),
)
def _(spark, d):
    return rounded(profiles.hour_month_table(market.error_history(spark, d), "mae", "UTC"))


_METRICS = """(SELECT zone, mean_price, std_price, neg_pct, price_range,
  CASE WHEN mean_price = 0 THEN 0 ELSE std_price / abs(mean_price) END AS cv_price,
  coalesce(label, zone) AS label, coalesce(entry_cost_eur, 50000e0) AS entry_cost_eur, annual_cost,
  EXISTS (SELECT 1 FROM ws WHERE ws.zone = s.zone) AS has_wind_solar,
  EXISTS (SELECT 1 FROM l WHERE l.zone = s.zone) AS has_load
FROM (SELECT zone, avg(price_eur_mwh) AS mean_price, stddev_samp(price_eur_mwh) AS std_price,
        avg(CASE WHEN price_eur_mwh < 0 THEN 1e0 ELSE 0e0 END) * 100 AS neg_pct,
        max(price_eur_mwh) - min(price_eur_mwh) AS price_range FROM p GROUP BY zone) s
LEFT JOIN dim USING (zone))"""


def _unit(c: str) -> str:
    return f"(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0))"


_SCORED = f"""(SELECT *, 0.35e0 * cv_price_norm + 0.25e0 * neg_pct_norm + 0.2e0 * entry_cost_eur_norm
  + 0.2e0 * data_score AS attractiveness
FROM (SELECT *, coalesce({_unit("cv_price")}, 0.5e0) AS cv_price_norm,
        coalesce({_unit("neg_pct")}, 0.5e0) AS neg_pct_norm,
        coalesce(1 - {_unit("entry_cost_eur")}, 0.5e0) AS entry_cost_eur_norm,
        (has_wind_solar::INTEGER + has_load::INTEGER) / 2e0 AS data_score FROM {_METRICS}))"""


def _metrics(spark, d):
    return profiles.zone_metrics(
        market.prices(spark, d), market.zone_dim(spark), market.wind_solar(spark, d),
        market.load(spark, d),
    )


_METRIC_DOUBLES = "mean_price std_price neg_pct price_range cv_price"


@query("f15_zone_metrics", sql(f"SELECT * FROM {_METRICS}", "p ws l dim", _METRIC_DOUBLES))
def _(spark, d):
    return rounded(_metrics(spark, d))


@query(
    "f16_attractiveness",
    sql(
        f"SELECT * FROM {_SCORED}",
        "p ws l dim",
        _METRIC_DOUBLES + " cv_price_norm neg_pct_norm entry_cost_eur_norm data_score attractiveness",
    ),
)
def _(spark, d):
    return rounded(profiles.attractiveness(_metrics(spark, d)))


@query(
    "f17_ranked_zones",
    sql(
        f"""SELECT zone, attractiveness,
  CAST(row_number() OVER (ORDER BY attractiveness DESC, zone) AS INTEGER) AS rank FROM {_SCORED}""",
        "p ws l dim",
        "attractiveness",
    ),
)
def _(spark, d):
    scored = profiles.attractiveness(_metrics(spark, d))
    ranked = profiles.ranked(scored.select("zone", "attractiveness"), "attractiveness")
    return rounded(ranked)


@query(
    "f18_error_by_hour",
    sql(
        "SELECT zone, hour, avg(abs(actual_price - predicted_price)) AS mae FROM pred GROUP BY 1, 2",
        "pred",
        "mae",
    ),
)
def _(spark, d):
    rows = predictions(spark, d)
    return rounded(
        profiles.error_by_hour(rows, "actual_price", "predicted_price", "Europe/Copenhagen")
    )


_WIND = ["wind_onshore_mw", "wind_offshore_mw", "solar_mw"]


@query(
    "f19_null_share",
    sql(
        " UNION ALL ".join(
            f"""SELECT zone, '{c}' AS "column",
  avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100 AS null_pct FROM ws GROUP BY zone"""
            for c in _WIND
        ),
        "ws",
        "null_pct",
    ),
)
def _(spark, d):
    return rounded(profiles.null_share(market.wind_solar(spark, d), _WIND))
