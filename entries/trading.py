"""Signals, P&L, risk and earnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import (
    SUMMARY_DOUBLES,
    predictions,
    registry,
    results,
    rounded,
    sql,
    summary_sql,
    with_baseline,
)
from tidegrid.functions.time import local_date
from tidegrid.operators import align, trading
from tidegrid.operators.features import similar_day
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()

_DAYS = "(SELECT DISTINCT zone, CAST(ts_utc + INTERVAL 1 HOUR AS DATE) AS d FROM p)"
_ELIGIBLE = f"""(SELECT zone, d AS fold_day FROM (
  SELECT *, min(d) OVER (PARTITION BY zone) AS first FROM {_DAYS}) WHERE d >= first + 7)"""


def _dated(spark, d):
    return market.prices(spark, d).withColumn("local_date", local_date("ts_utc"))


@query("h01_fold_days", sql(f"SELECT * FROM {_ELIGIBLE}", "p"))
def _(spark, d):
    return align.fold_days(_dated(spark, d), "local_date", 7)


_SAMPLED = f"""(SELECT e.zone, fold_day FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY fold_day) - 1 AS i,
    count(*) OVER (PARTITION BY zone) AS n FROM {_ELIGIBLE}) e
WHERE n <= 10 OR i IN (SELECT CAST(floor(k * ((n - 1) / 9e0)) AS BIGINT)
                       FROM generate_series(0, 9) t(k)))"""


@query("h02_sampled_days", sql(f"SELECT * FROM {_SAMPLED}", "p"))
def _(spark, d):
    return trading.sample_days(_dated(spark, d), 10, 7)


@query(
    "h03_unscored_days",
    sql(
        f"""SELECT * FROM {_ELIGIBLE} a WHERE NOT EXISTS (
  SELECT 1 FROM {_SAMPLED} s WHERE s.zone = a.zone AND s.fold_day = a.fold_day)""",
        "p",
    ),
)
def _(spark, d):
    rows = _dated(spark, d)
    scored = trading.sample_days(rows, 10, 7).withColumnRenamed("fold_day", "local_date")
    return trading.unscored_days(align.fold_days(rows, "local_date", 7), scored)


@query(
    "h03_merge_results",
    sql(
        """SELECT zone, ts_utc, coalesce(b.baseline, p.predicted_price) AS predicted_price
FROM pred p LEFT JOIN (SELECT zone, ts_utc, baseline FROM pb) b USING (zone, ts_utc)""",
        "pred pb",
    ),
)
def _(spark, d):
    stored = predictions(spark, d).select("zone", "ts_utc", "predicted_price")
    fresh = with_baseline(spark, d).select(
        "zone", "ts_utc", F.col("baseline").alias("predicted_price")
    )
    return trading.merge_results(stored, fresh)


@query("h04_rank_spread_signals", sql("SELECT zone, ts_utc, position FROM sig", "sig"))
def _(spark, d):
    return trading.rank_spread(predictions(spark, d)).select("zone", "ts_utc", "position")


_THRESHOLD = """(SELECT *, CASE WHEN predicted_price - baseline > 5 THEN 1e0
  WHEN predicted_price - baseline < -5 THEN -1e0 ELSE 0e0 END AS position FROM pb)"""


@query(
    "h05_threshold_signals", sql(f"SELECT zone, ts_utc, position FROM {_THRESHOLD}", "pb")
)
def _(spark, d):
    made = trading.threshold_signals(with_baseline(spark, d), "baseline")
    return made.select("zone", "ts_utc", "position")


@query(
    "h06_capped_daily_trades",
    sql(
        f"""SELECT zone, ts_utc, CASE WHEN r <= 3 THEN position ELSE 0e0 END AS position
FROM (SELECT *, row_number() OVER (PARTITION BY zone, local_date
        ORDER BY (position <> 0) DESC, abs(predicted_price - baseline) DESC, ts_utc) AS r
      FROM {_THRESHOLD})""",
        "pb",
    ),
)
def _(spark, d):
    made = trading.threshold_signals(with_baseline(spark, d), "baseline", max_daily_trades=3)
    return made.select("zone", "ts_utc", "position")


@query("h07_pnl", sql("SELECT zone, ts_utc, position, pnl FROM res", "res", "pnl"))
def _(spark, d):
    return rounded(results(spark, d).select("zone", "ts_utc", "position", "pnl"), "pnl")


@query(
    "h08_daily_pnl",
    sql("SELECT zone, local_date, sum(pnl) AS pnl FROM res GROUP BY 1, 2", "res", "pnl"),
)
def _(spark, d):
    return rounded(trading.daily_pnl(results(spark, d)))


@query(
    "h08_daily_pnl_stats",
    sql(
        """SELECT zone, count(*) AS n_days, sum(x) AS total_pnl, avg(x) AS daily_pnl_mean,
  stddev_samp(x) AS daily_pnl_std
FROM (SELECT zone, local_date, sum(pnl) AS x FROM res GROUP BY 1, 2) GROUP BY zone""",
        "res",
        "total_pnl daily_pnl_mean daily_pnl_std",
    ),
)
def _(spark, d):
    return rounded(trading.daily_pnl_stats(results(spark, d)))


_CURVE = """(SELECT *, peak - cumulative AS drawdown FROM (
  SELECT *, max(cumulative) OVER (PARTITION BY zone ORDER BY ts_utc) AS peak FROM (
    SELECT zone, ts_utc, sum(pnl) OVER (PARTITION BY zone ORDER BY ts_utc) AS cumulative
    FROM res)))"""


@query(
    "h09_cumulative_pnl_and_drawdown",
    sql(f"SELECT * FROM {_CURVE}", "res", "cumulative peak drawdown"),
)
def _(spark, d):
    curve = trading.drawdown_curve(results(spark, d))
    return rounded(curve.select("zone", "ts_utc", "cumulative", "peak", "drawdown"))


@query(
    "h09_max_drawdown",
    sql(
        f"SELECT zone, max(drawdown) AS max_drawdown FROM {_CURVE} GROUP BY zone",
        "res",
        "max_drawdown",
    ),
)
def _(spark, d):
    return rounded(trading.max_drawdown(results(spark, d)))


_SUMMARY = summary_sql("zone", "res")


def _figure(name: str, column: str, operator):
    @query(name, sql(f"SELECT zone, {column} FROM ({_SUMMARY})", "res", column))
    def _(spark, d):
        return rounded(operator(results(spark, d)))


_figure("h10_sharpe_ratio", "sharpe_ratio", trading.sharpe_ratio)
_figure("h11_sortino_ratio", "sortino_ratio", trading.sortino_ratio)
_figure("h12_calmar_ratio", "calmar_ratio", trading.calmar_ratio)
_figure("h13_profit_factor", "profit_factor", trading.profit_factor)
_figure("h14_win_rate", "win_rate_pct", trading.win_rate)


@query("h15_backtest_summary", sql(f"SELECT * FROM ({_SUMMARY})", "res", SUMMARY_DOUBLES))
def _(spark, d):
    return rounded(trading.backtest_summary(results(spark, d)))


@query(
    "h15_threshold_strategy_summary",
    sql(
        f"""SELECT * FROM ({summary_sql("zone", "tres")})""", "pb", SUMMARY_DOUBLES
    ).replace(
        "\nSELECT * FROM (\nSELECT",
        f""",
tres AS (SELECT *, -position * (actual_price - avg(actual_price) OVER (PARTITION BY zone, local_date))
  - abs(position) * 0.15e0 AS pnl FROM {_THRESHOLD})
SELECT * FROM (\nSELECT""",
        1,
    ),
)
def _(spark, d):
    rows = trading.threshold_signals(with_baseline(spark, d), "baseline")
    return rounded(trading.backtest_summary(trading.pnl(rows, trading.SCENARIO_FEE_EUR_MWH)))


@query(
    "h15_baseline_forecast_summary",
    sql(f"SELECT * FROM ({summary_sql('zone', 'res')})", "res", SUMMARY_DOUBLES).replace(
        "FROM lags WHERE d1 IS NOT NULL AND price_eur_mwh IS NOT NULL",
        """FROM (SELECT lags.* REPLACE (CASE WHEN isodow(ts_utc + INTERVAL 1 HOUR) IN (1, 6, 7)
                              THEN d7 ELSE d1 END AS d1) FROM lags)
  WHERE d1 IS NOT NULL AND price_eur_mwh IS NOT NULL""",
    ),
)
def _(spark, d):
    from entries.base import PRICE, grid

    rows = similar_day(grid(spark, d)).where(f"baseline IS NOT NULL AND {PRICE} IS NOT NULL")
    forecast = rows.select(
        "zone", "ts_utc", F.col("baseline").alias("predicted_price"),
        F.col(PRICE).alias("actual_price"),
    )
    return rounded(trading.backtest_summary(trading.pnl(trading.rank_spread(forecast))))


@query(
    "h16_pnl_by_hour",
    sql("SELECT zone, hour, sum(pnl) AS pnl FROM res GROUP BY 1, 2", "res", "pnl"),
)
def _(spark, d):
    return rounded(trading.pnl_by_hour(results(spark, d)))


@query(
    "h16_pnl_by_month",
    sql(
        """SELECT zone, strftime(local_date, '%Y-%m') AS month, sum(pnl) AS pnl
FROM res GROUP BY 1, 2""",
        "res",
        "pnl",
    ),
)
def _(spark, d):
    return rounded(trading.pnl_by_month(results(spark, d)))


_SWEEP = """swept AS (SELECT *, -position * (actual_price
    - avg(actual_price) OVER (PARTITION BY zone, threshold_eur, local_date)) AS pnl
  FROM (SELECT pb.*, threshold_eur, CASE WHEN predicted_price - baseline > threshold_eur THEN 1e0
          WHEN predicted_price - baseline < -threshold_eur THEN -1e0 ELSE 0e0 END AS position
        FROM pb CROSS JOIN (VALUES (2e0), (5e0), (8e0), (12e0), (15e0)) t(threshold_eur)))"""


@query(
    "h17_threshold_sweep",
    sql(
        f"""SELECT zone, threshold_eur, total_pnl, sharpe_ratio, win_rate_pct, n_trades, max_drawdown
FROM ({summary_sql("zone, threshold_eur", "swept")})""",
        "pb",
        "total_pnl sharpe_ratio win_rate_pct max_drawdown",
    ).replace("\nSELECT zone, threshold_eur", f",\n{_SWEEP}\nSELECT zone, threshold_eur", 1),
)
def _(spark, d):
    return rounded(trading.threshold_sweep(with_baseline(spark, d), "baseline"))


@query(
    "h18_earnings",
    sql(
        f"""SELECT *, after_haircut_50pct - annual_cost AS net_base_case,
  after_haircut_25pct - annual_cost AS net_conservative
FROM (SELECT zone, total_pnl, n_trading_days, gross AS gross_annual,
        gross * 0.5 AS after_haircut_50pct, gross * 0.25 AS after_haircut_25pct, label,
        coalesce(annual_cost, 30000e0) AS annual_cost
      FROM (SELECT *, total_pnl * 10 * (365e0 / n_trading_days) AS gross FROM ({_SUMMARY}))
      LEFT JOIN dim USING (zone))""",
        "res dim",
        "total_pnl gross_annual after_haircut_50pct after_haircut_25pct annual_cost net_base_case "
        "net_conservative",
    ),
)
def _(spark, d):
    return rounded(
        trading.earnings(trading.backtest_summary(results(spark, d)), market.zone_dim(spark))
    )


@query(
    "h19_profit_scenarios",
    sql(
        f"""SELECT zone, scenario, net * kept AS annual_eur, net * kept * 7.46e0 AS annual_dkk,
  net * kept / 12 AS monthly_eur, net * kept / 12 * 7.46e0 AS monthly_dkk
FROM (SELECT zone, total_pnl * 10 * (365e0 / n_trading_days)
        - n_trades * (365e0 / n_trading_days) * 0.15e0 * 10 AS net FROM ({_SUMMARY}))
CROSS JOIN (VALUES ('conservative', 0.4e0), ('base', 0.6e0), ('optimistic', 0.8e0)) s(scenario, kept)""",
        "res",
        "annual_eur annual_dkk monthly_eur monthly_dkk",
    ),
)
def _(spark, d):
    return rounded(trading.profit_scenarios(trading.backtest_summary(results(spark, d))))
