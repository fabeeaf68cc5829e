"""Error history and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import registry, rounded, sql
from tidegrid.operators import monitor
from tidegrid.session import staging_path
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()


@query("i01_append_observations", sql("SELECT zone, ts_utc, mae FROM eh", "eh"))
def _(spark, d):
    path = staging_path(spark, "history")
    history = market.error_history(spark, d)
    early = F.year("ts_utc") < 1997
    for batch in (history.where(early), history.where(~early)):
        monitor.append_observation(path, batch)
    return spark.read.parquet(path)


@query(
    "i02_drift_status",
    sql(
        """SELECT zone, current_mae, round(s, 4) AS rolling_7d_mae, round(l, 4) AS rolling_30d_mae,
  n >= 7 AND s > 2 * l AS is_drifting,
  CASE WHEN n >= 7 AND s > 2 * l
         THEN format('DRIFT DETECTED for {}: 7-day MAE ({:.2f}) exceeds 2x 30-day MAE ({:.2f})',
                     zone, s, l)
       WHEN n < 7 THEN format('{}: not enough history for drift detection ({} observations)', zone, n)
       ELSE format('{}: model performance stable (7d={:.2f}, 30d={:.2f})', zone, s, l) END AS message
FROM (SELECT zone, max(mae) FILTER (WHERE k = 1) AS current_mae, avg(mae) FILTER (WHERE k <= 7) AS s,
        avg(mae) FILTER (WHERE k <= 30) AS l, count(*) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts_utc DESC) AS k FROM eh)
      GROUP BY zone)""",
        "eh",
    ),
)
def _(spark, d):
    return monitor.drift_status(market.error_history(spark, d))


@query(
    "i03_drift_history",
    sql(
        """SELECT zone, ts_utc, mae, s AS rolling_7d_mae, l AS rolling_30d_mae,
  n >= 7 AND s > 2 * l AS is_drifting
FROM (SELECT *, avg(mae) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s,
        avg(mae) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l,
        count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n
      FROM eh WINDOW w AS (PARTITION BY zone ORDER BY ts_utc))""",
        "eh",
        "rolling_7d_mae rolling_30d_mae",
        places=9,
    ),
)
def _(spark, d):
    history = monitor.drift_history(market.error_history(spark, d))
    return rounded(history, "rolling_7d_mae", "rolling_30d_mae", places=9)
