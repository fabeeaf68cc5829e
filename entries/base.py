"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import tidy
from tidegrid.operators.align import to_grid
from tidegrid.operators.features import similar_day
from tidegrid.operators.trading import pnl, rank_spread
from tidegrid.operators.blocks import trailing
from tidegrid.sources import market_events as market

PRICE = "price_eur_mwh"
WIND = ["wind_onshore_mw", "wind_offshore_mw", "solar_mw"]
PRIORITY = ("energinet", "entsoe")
EVENT_ZONES = ["click", "error", "purchase", "signup", "view"]


def registry():
    """Fresh query and SQL tables with the decorator that fills them."""
    queries: dict = {}
    statements: dict = {}

    def query(name: str, statement: str | None = None):
        def register(fn):
            queries[name] = fn
            if statement is not None:
                statements[name] = statement
            return fn

        return register

    return queries, statements, query


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round the named columns, or every double column when none is named."""
    doubles = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: tidy(F.col(c), places) for c in doubles})


def grid(spark, sf_dir: str) -> DataFrame:
    return to_grid(market.prices(spark, sf_dir), [PRICE])


def predictions(spark, sf_dir: str) -> DataFrame:
    """Yesterday's price as the forecast of every priced hour."""
    lagged = trailing(
        grid(spark, sf_dir), 24, lambda w: {"predicted_price": F.lag(PRICE, 24).over(w)}
    )
    return lagged.where(
        F.col("predicted_price").isNotNull() & F.col(PRICE).isNotNull()
    ).select("zone", "ts_utc", "predicted_price", F.col(PRICE).alias("actual_price"))


def with_baseline(spark, sf_dir: str) -> DataFrame:
    """Predictions next to the similar-day baseline, where both exist."""
    base = similar_day(grid(spark, sf_dir)).select("zone", "ts_utc", "baseline")
    return predictions(spark, sf_dir).join(base, ["zone", "ts_utc"]).where("baseline IS NOT NULL")


def results(spark, sf_dir: str) -> DataFrame:
    """Rank-spread positions and P&L on the predictions."""
    return pnl(rank_spread(predictions(spark, sf_dir)))


# ------------------------------------------------------------------------ SQL
# January 2024 is all winter time, so local market time is UTC + 1 hour.

CTES = {
    "ev": """ev AS (
  SELECT event_id, ts, user_id, event_type AS zone, value, props,
         date_trunc('hour', ts) AS h,
         CAST(round(value * 100) AS BIGINT) AS c,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN second(ts) < 30 THEN 'energinet' ELSE 'entsoe' END AS source
  FROM events)""",
    "p": """p AS (
  SELECT zone, h AS ts_utc, CAST(sum(c) AS BIGINT) / (count(*) * 100e0) - 25e0 AS price_eur_mwh
  FROM ev GROUP BY zone, h)""",
    "ps": """ps AS (
  SELECT source, zone, h AS ts_utc,
         CAST(sum(c) AS BIGINT) / (count(*) * 100e0) - 25e0 AS price_eur_mwh
  FROM ev GROUP BY source, zone, h)""",
    "ws": """ws AS (
  SELECT zone, h AS ts_utc,
         CAST(sum(c) FILTER (WHERE k < 34) AS BIGINT) / 10e0 AS wind_onshore_mw,
         CAST(sum(c) FILTER (WHERE k >= 34 AND k < 67) AS BIGINT) / 10e0 AS wind_offshore_mw,
         coalesce(CAST(sum(c) FILTER (WHERE k >= 67 AND hour(ts) BETWEEN 7 AND 18) AS BIGINT), 0)
           / 100e0 AS solar_mw
  FROM ev GROUP BY zone, h)""",
    "wsrc": """wsrc AS (
  SELECT source, zone, h AS ts_utc,
         CAST(sum(c) FILTER (WHERE k < 34) AS BIGINT) / 10e0 AS wind_onshore_mw
  FROM ev GROUP BY source, zone, h)""",
    "l": """l AS (
  SELECT zone, h AS ts_utc, CAST(sum(c) AS BIGINT) / 100e0 + 3000e0 AS load_mw
  FROM ev GROUP BY zone, h)""",
    "act": """act AS (
  SELECT zone, h AS ts_utc, CAST(sum(c) AS BIGINT) / 10e0 AS wind_actual_mw
  FROM ev GROUP BY zone, h)""",
    "edges": """edges(from_zone, to_zone, capacity_mw) AS (
  SELECT * FROM (VALUES ('click', 'view', 500), ('view', 'purchase', 400),
    ('purchase', 'signup', 300), ('signup', 'error', 200), ('error', 'click', 100)))""",
    "dim": """dim(zone, label, entry_cost_eur, annual_cost) AS (
  SELECT * FROM (VALUES ('click', 'Click zone', 25000e0, 15000e0),
    ('view', 'View zone', 30000e0, 18000e0), ('purchase', 'Purchase zone', 50000e0, 35000e0),
    ('signup', 'Signup zone', 45000e0, 30000e0)))""",
    "eh": """eh AS (
  SELECT o_orderpriority AS zone, o_orderdate AS ts_utc,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT)
           / (count(*) * 1000000e0) AS mae
  FROM orders GROUP BY 1, 2)""",
    "hrs": """hrs AS (
  SELECT zone, unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 1 HOUR)) AS ts_utc
  FROM p GROUP BY zone)""",
    "g": """g AS (
  SELECT hrs.zone, hrs.ts_utc, p.price_eur_mwh FROM hrs LEFT JOIN p USING (zone, ts_utc))""",
    "lags": """lags AS (
  SELECT *, lag(price_eur_mwh, 24) OVER w AS d1, lag(price_eur_mwh, 168) OVER w AS d7
  FROM g WINDOW w AS (PARTITION BY zone ORDER BY ts_utc))""",
    "pred": """pred AS (
  SELECT zone, ts_utc, d1 AS predicted_price, price_eur_mwh AS actual_price,
         CAST(ts_utc + INTERVAL 1 HOUR AS DATE) AS local_date,
         CAST(hour(ts_utc + INTERVAL 1 HOUR) AS INTEGER) AS hour
  FROM lags WHERE d1 IS NOT NULL AND price_eur_mwh IS NOT NULL)""",
    "base": """base AS (
  SELECT zone, ts_utc,
         CASE WHEN isodow(ts_utc + INTERVAL 1 HOUR) IN (1, 6, 7) THEN d7 ELSE d1 END AS baseline
  FROM lags)""",
    "pb": """pb AS (
  SELECT pred.*, baseline FROM pred JOIN base USING (zone, ts_utc) WHERE baseline IS NOT NULL)""",
    "sig": """sig AS (
  SELECT zone, ts_utc, local_date, hour, predicted_price, actual_price,
         CASE WHEN n < 8 THEN 0e0 WHEN dear <= 4 THEN -1e0 WHEN cheap <= 4 THEN 1e0
              ELSE 0e0 END AS position
  FROM (SELECT *,
          row_number() OVER (PARTITION BY zone, local_date ORDER BY predicted_price, ts_utc)
            AS cheap,
          row_number() OVER (PARTITION BY zone, local_date ORDER BY predicted_price DESC, ts_utc)
            AS dear,
          count(*) OVER (PARTITION BY zone, local_date) AS n
        FROM pred))""",
    "res": """res AS (
  SELECT *, -position * (actual_price - avg(actual_price) OVER (PARTITION BY zone, local_date))
            - abs(position) * 0.04e0 AS pnl
  FROM sig)""",
}

_NEEDS = {
    "p": ["ev"], "ps": ["ev"], "ws": ["ev"], "wsrc": ["ev"], "l": ["ev"], "act": ["ev"],
    "hrs": ["p"], "g": ["hrs", "p"], "lags": ["g"], "pred": ["lags"], "base": ["lags"],
    "pb": ["pred", "base"], "sig": ["pred"], "res": ["sig"],
}


def _ordered(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for need in _NEEDS.get(n, []):
            visit(need)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, ctes: str = "", r: str = "", places: int = 6) -> str:
    """``body`` with the named common table expressions; ``r`` lists the output
    columns to round, matching ``rounded``."""
    names = _ordered(ctes.split())
    text = "WITH " + ",\n".join(CTES[n] for n in names) + "\n" + body if names else body
    if r:
        swaps = ", ".join(f"round({c}, {places}) + 0 AS {c}" for c in r.split())
        text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)"
    return text


def summary_sql(keys: str, source: str) -> str:
    """The performance figures per ``keys`` of an hourly result relation."""
    return f"""
SELECT {keys}, total_pnl, daily_pnl_mean, daily_pnl_std,
  CASE WHEN daily_pnl_std = 0 THEN CASE WHEN daily_pnl_mean > 0 THEN 'inf'::DOUBLE ELSE 0e0 END
       ELSE daily_pnl_mean / daily_pnl_std END * sqrt(365e0) AS sharpe_ratio,
  CASE WHEN n_down = 0 OR down_std = 0
         THEN CASE WHEN daily_pnl_mean > 0 THEN 'inf'::DOUBLE ELSE 0e0 END
       ELSE daily_pnl_mean / down_std END * sqrt(365e0) AS sortino_ratio,
  CASE WHEN max_drawdown = 0 THEN CASE WHEN total_pnl > 0 THEN 'inf'::DOUBLE ELSE 0e0 END
       ELSE total_pnl * (365e0 / n_trading_days) / max_drawdown END AS calmar_ratio,
  CASE WHEN gross_loss = 0 THEN CASE WHEN gross_win > 0 THEN 'inf'::DOUBLE ELSE 0e0 END
       ELSE gross_win / gross_loss END AS profit_factor,
  max_drawdown,
  CASE WHEN wins + losses = 0 THEN 0e0 ELSE wins * 100e0 / (wins + losses) END AS win_rate_pct,
  n_trades, n_trading_days,
  CASE WHEN wins = 0 THEN 0e0 ELSE won / wins END AS avg_win,
  CASE WHEN losses = 0 THEN 0e0 ELSE lost / losses END AS avg_loss
FROM (
  SELECT {keys}, sum(day_pnl) AS total_pnl, avg(day_pnl) AS daily_pnl_mean,
    stddev_samp(day_pnl) AS daily_pnl_std,
    stddev_samp(day_pnl) FILTER (WHERE day_pnl < 0) AS down_std,
    count(*) FILTER (WHERE day_pnl < 0) AS n_down, count(*) AS n_trading_days
  FROM (SELECT {keys}, local_date, sum(pnl) AS day_pnl FROM {source} GROUP BY {keys}, local_date)
  GROUP BY {keys}) AS daily
JOIN (
  SELECT {keys}, max(peak - cumulative) AS max_drawdown,
    count(*) FILTER (WHERE position <> 0) AS n_trades,
    count(*) FILTER (WHERE position <> 0 AND pnl > 0) AS wins,
    count(*) FILTER (WHERE position <> 0 AND pnl < 0) AS losses,
    coalesce(sum(pnl) FILTER (WHERE position <> 0 AND pnl > 0), 0) AS won,
    coalesce(sum(pnl) FILTER (WHERE position <> 0 AND pnl < 0), 0) AS lost,
    coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gross_win,
    coalesce(sum(-pnl) FILTER (WHERE pnl < 0), 0) AS gross_loss
  FROM (SELECT *, max(cumulative) OVER (PARTITION BY {keys} ORDER BY ts_utc) AS peak
        FROM (SELECT *, sum(pnl) OVER (PARTITION BY {keys} ORDER BY ts_utc) AS cumulative
              FROM {source}))
  GROUP BY {keys}) AS hourly USING ({keys})"""


SUMMARY_DOUBLES = (
    "total_pnl daily_pnl_mean daily_pnl_std sharpe_ratio sortino_ratio calmar_ratio "
    "profit_factor max_drawdown win_rate_pct avg_win avg_loss"
)
