"""Splits, learners, scoring and walk-forward forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, predictions, registry, rounded, sql, with_baseline
from tidegrid.functions.time import local_date, local_hour
from tidegrid.operators import boosting, features, forecast, trading
from tidegrid.session import staged
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()

MODEL_FEATURES = [
    *features.LAG_FEATURES, *features.CALENDAR_FEATURES, "residual_load_mw", "load_mw",
    "wind_total_mw", "wind_capacity_factor", "solar_mw",
]


def _matrix(spark, d, zone: str = "event_type"):
    """The complete feature matrix as a written table; models read it often."""
    matrix = features.feature_matrix(
        market.prices(spark, d, zone), market.load(spark, d, zone),
        market.wind_solar(spark, d, zone), complete=True,
    )
    return staged(matrix, "matrix")


def _split(spark, d):
    return forecast.temporal_split(_matrix(spark, d))


@query(
    "g01_temporal_split",
    sql(
        """SELECT zone, ts_utc, row_number() OVER (PARTITION BY zone ORDER BY ts_utc) - 1
  < floor(count(*) OVER (PARTITION BY zone) * 0.7e0) AS is_train FROM p""",
        "p",
    ),
)
def _(spark, d):
    return forecast.temporal_split(market.prices(spark, d)).select("zone", "ts_utc", "is_train")


_MODELS: dict = {}


def _boosted(spark, d, rows):
    """The fitted model of a data set, from its split ``rows``; the two queries on it share one fit."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = forecast.fit_gbt(rows.where("is_train"), PRICE, MODEL_FEATURES)
    return _MODELS[key]


@query("g02_boosted_trees")
def _(spark, d):
    rows = staged(_split(spark, d), "split")  # the matrix costs as much as many trees: made once
    scored = forecast.score(_boosted(spark, d, rows), rows.where(~F.col("is_train")), MODEL_FEATURES)
    return scored.select("zone", "ts_utc", F.col(PRICE).alias("actual_price"), "predicted_price")


@query("g05_feature_importance")
def _(spark, d):
    rows = staged(_split(spark, d), "split")
    return forecast.importance(_boosted(spark, d, rows), rows, MODEL_FEATURES)


@query("g03_g04_per_hour_ridge")
def _(spark, d):
    rows = _split(spark, d)
    models = forecast.fit_ridge_per_hour(rows.where("is_train"), PRICE, MODEL_FEATURES)
    scored = forecast.predict_per_hour(models, rows.where(~F.col("is_train")), MODEL_FEATURES)
    return scored.select("zone", "ts_utc", F.col(PRICE).alias("actual_price"), "predicted_price")


@query("g02_boosted_per_zone")
def _(spark, d):
    rows = staged(_split(spark, d), "split")
    models = boosting.fit_boosted(rows.where("is_train"), PRICE, MODEL_FEATURES)
    scored = boosting.predict_boosted(models, rows.where("NOT is_train"), MODEL_FEATURES)
    return scored.select("zone", "ts_utc", F.col(PRICE).alias("actual_price"), "predicted_price")


@query("g05_boosted_importance_per_zone")
def _(spark, d):
    train = _split(spark, d).where("is_train")
    models = boosting.fit_boosted(train, PRICE, MODEL_FEATURES)
    return boosting.importance_table(models, MODEL_FEATURES, ["zone"])


@query("g05_permutation_importance")
def _(spark, d):
    rows = staged(_split(spark, d), "split")
    models = boosting.fit_boosted(rows.where("is_train"), PRICE, MODEL_FEATURES)
    score = lambda copies: boosting.predict_boosted(models, copies, MODEL_FEATURES)
    return boosting.permutation_importance(rows.where("NOT is_train"), score, PRICE, MODEL_FEATURES)


def _ridge(slope: str = "m.slope", icpt_x: str = "m.mx", icpt_y: str = "m.my") -> str:
    """One-feature ridge on standardised x with penalty 1: slope·n/(n + 1)."""
    beta = f"({slope} * m.n / (m.n + 1e0))"
    return f"{icpt_y} - {beta} * {icpt_x} + {beta}"


_REGRESSION = """count(*) AS n, avg(x) AS mx, avg(y) AS my,
  coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 0) AS slope"""


@query(
    "g03_g04_per_hour_single_feature",
    sql(
        f"""WITH s AS (SELECT zone, ts_utc, hour, predicted_price AS x, actual_price AS y,
  row_number() OVER (PARTITION BY zone ORDER BY ts_utc) - 1
    < floor(count(*) OVER (PARTITION BY zone) * 0.7e0) AS is_train FROM pred)
SELECT s.zone, s.ts_utc, coalesce({_ridge()} * s.x, 0) AS predicted_price
FROM s LEFT JOIN (SELECT zone, hour, {_REGRESSION} FROM s WHERE is_train GROUP BY zone, hour
                  HAVING count(*) >= 10) m ON m.zone = s.zone AND m.hour = s.hour
WHERE NOT s.is_train""",
        "pred",
        "predicted_price",
    ).replace("WITH s AS", ", s AS", 1),
)
def _(spark, d):
    rows = forecast.temporal_split(
        predictions(spark, d).withColumnRenamed("predicted_price", "yesterday")
    )
    models = forecast.fit_ridge_per_hour(rows.where("is_train"), "actual_price", ["yesterday"])
    scored = forecast.predict_per_hour(models, rows.where(~F.col("is_train")), ["yesterday"])
    return rounded(scored.select("zone", "ts_utc", "predicted_price"))


_METRICS = """avg(abs(actual_price - {p})) AS mae, sqrt(avg((actual_price - {p}) * (actual_price - {p})))
    AS rmse,
  coalesce(100 * avg(abs(actual_price - {p}) / nullif((abs(actual_price) + abs({p})) / 2, 0)), 0)
    AS smape, count(*) AS n_samples"""


@query(
    "g06_error_metrics",
    sql(
        f"SELECT zone, {_METRICS.format(p='predicted_price')} FROM pred GROUP BY zone",
        "pred",
        "mae rmse smape",
    ),
)
def _(spark, d):
    return rounded(forecast.evaluate(predictions(spark, d), "actual_price", "predicted_price"))


@query(
    "g07_evaluation_report",
    sql(
        f"""SELECT zone, hour, {_METRICS.format(p='predicted_price')} FROM pred
GROUP BY GROUPING SETS ((zone), (zone, hour))""",
        "pred",
        "mae rmse smape",
    ),
)
def _(spark, d):
    return rounded(
        forecast.evaluation_report(predictions(spark, d), "actual_price", "predicted_price")
    )


@query(
    "g08_rank_correlation",
    sql(
        """SELECT zone, avg(r) AS corr_f, count(r) AS n_days FROM (
  SELECT zone, local_date, CASE WHEN count(*) >= 12 THEN
      covar_samp(ra, rp) / nullif(stddev_samp(ra) * stddev_samp(rp), 0) END AS r
  FROM (SELECT zone, local_date,
          rank() OVER (PARTITION BY zone, local_date ORDER BY actual_price)
            + (count(*) OVER (PARTITION BY zone, local_date, actual_price) - 1) / 2e0 AS ra,
          rank() OVER (PARTITION BY zone, local_date ORDER BY predicted_price)
            + (count(*) OVER (PARTITION BY zone, local_date, predicted_price) - 1) / 2e0 AS rp
        FROM pred) GROUP BY zone, local_date) GROUP BY zone""",
        "pred",
        "corr_f",
    ),
)
def _(spark, d):
    return rounded(
        forecast.rank_correlation(predictions(spark, d), "actual_price", "predicted_price")
    )


_SIDES = {"model": "predicted_price", "baseline": "baseline"}
_NAMES = ("mae", "rmse", "smape")


def _side(side: str) -> str:
    text = _METRICS.format(p=_SIDES[side]).replace(", count(*) AS n_samples", "")
    for n in _NAMES:
        text = text.replace(f"AS {n}", f"AS {n}_{side}")
    return text


@query(
    "g09_skill_against_baseline",
    sql(
        "SELECT *, "
        + ", ".join(
            f"({n}_baseline - {n}_model) / nullif({n}_baseline, 0) * 100 AS {n}_improvement_pct"
            for n in _NAMES
        )
        + f" FROM (SELECT zone, {_side('model')}, {_side('baseline')} FROM pb GROUP BY zone)",
        "pb",
        " ".join(f"{n}_{s}" for n in _NAMES for s in ("model", "baseline", "improvement_pct")),
    ),
)
def _(spark, d):
    return rounded(
        forecast.skill(with_baseline(spark, d), "actual_price", "predicted_price", "baseline")
    )


@query(
    "g10_winner_by_hour",
    sql(
        """SELECT *, CASE WHEN mae_single < mae_per_hour THEN 'Single' ELSE 'Per-Hour' END AS winner
FROM (SELECT zone, hour, avg(abs(actual_price - predicted_price)) AS mae_single,
        avg(abs(actual_price - baseline)) AS mae_per_hour FROM pb GROUP BY zone, hour)""",
        "pb",
        "mae_single mae_per_hour",
    ),
)
def _(spark, d):
    return rounded(
        forecast.hourly_winner(
            with_baseline(spark, d), "actual_price", "predicted_price", "baseline"
        )
    )


@query("g11_walk_forward")
def _(spark, d):
    return forecast.walk_forward(_matrix(spark, d), PRICE, MODEL_FEATURES, window_days=7)


_FOLDS = """(SELECT DISTINCT zone, local_date AS fold
  FROM (SELECT *, min(local_date) OVER (PARTITION BY zone) AS first FROM pred)
  WHERE local_date >= first + 7)"""


@query(
    "g11_walk_forward_window_mean",
    sql(
        f"""SELECT p.zone, p.ts_utc, p.local_date, m.my AS predicted_price, p.actual_price
FROM pred p JOIN (SELECT f.zone, fold, avg(actual_price) AS my FROM {_FOLDS} f
  JOIN pred r ON r.zone = f.zone AND r.local_date < fold AND r.local_date >= fold - 7
  GROUP BY f.zone, fold HAVING count(*) >= 48) m ON m.zone = p.zone AND m.fold = p.local_date""",
        "pred",
        "predicted_price",
    ),
)
def _(spark, d):
    rows = predictions(spark, d).withColumnRenamed("predicted_price", "yesterday")
    made = forecast.walk_forward(rows, "actual_price", [], window_days=7)
    return rounded(made, "predicted_price")


@query(
    "g11_walk_forward_single_feature",
    sql(
        f"""SELECT p.zone, p.ts_utc, p.local_date, {_ridge()} * p.predicted_price AS predicted_price,
  p.actual_price
FROM pred p JOIN (SELECT zone, fold, {_REGRESSION} FROM (
    SELECT f.zone, fold, r.predicted_price AS x, r.actual_price AS y FROM {_FOLDS} f
    JOIN pred r ON r.zone = f.zone AND r.local_date < fold AND r.local_date >= fold - 7)
  GROUP BY zone, fold HAVING count(*) >= 48) m ON m.zone = p.zone AND m.fold = p.local_date""",
        "pred",
        "predicted_price",
    ),
)
def _(spark, d):
    rows = predictions(spark, d).withColumnRenamed("predicted_price", "yesterday")
    made = forecast.walk_forward(rows, "actual_price", ["yesterday"], window_days=7)
    return rounded(made, "predicted_price")


@query("g11_sampled_walk_forward")
def _(spark, d):
    rows = _matrix(spark, d).withColumn("local_date", local_date("ts_utc"))
    days = trading.sample_days(rows, 5, 7)
    return forecast.walk_forward(
        rows.drop("local_date"), PRICE, MODEL_FEATURES, window_days=7, folds=days
    )


# ------------------------------------------------- several years, 56-day windows

WINDOW = 56
_LONG = """lp AS (
  SELECT zone, ts_utc, CAST(ts_utc AS DATE) AS local_date, hour(ts_utc) AS hour,
         CAST(sum(c) AS BIGINT) / (count(*) * 100000e0) - 25e0 AS y,
         CAST(sum(k) AS BIGINT) / (count(*) * 1e0) AS x
  FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'minor' ELSE 'main' END AS zone,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS ts_utc,
               CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_custkey % 100 AS k
        FROM orders) GROUP BY 1, 2),
folds AS (
  SELECT DISTINCT zone, local_date AS fold
  FROM (SELECT *, min(local_date) OVER (PARTITION BY zone) AS first FROM lp)
  WHERE local_date >= first + 56),
win AS (
  SELECT f.zone, fold, hour, x, y FROM folds f
  JOIN lp r ON r.zone = f.zone AND r.local_date < fold AND r.local_date >= fold - 56),
usable AS (SELECT zone, fold FROM win GROUP BY zone, fold HAVING count(*) >= 48)"""


def _long_sql(body: str) -> str:
    return (
        f"SELECT * REPLACE (round(predicted_price, 6) + 0 AS predicted_price) FROM (\nWITH {_LONG}\n{body})"
    )


@query(
    "g11_long_walk_forward",
    _long_sql(
        f"""SELECT p.zone, p.ts_utc, p.local_date, {_ridge()} * p.x AS predicted_price, p.y AS actual_price
FROM lp p JOIN (SELECT zone, fold, {_REGRESSION} FROM win JOIN usable USING (zone, fold)
                GROUP BY zone, fold) m ON m.zone = p.zone AND m.fold = p.local_date"""
    ),
)
def _(spark, d):
    rows = market.long_series(spark, d)
    made = forecast.walk_forward(rows, PRICE, ["demand"], window_days=WINDOW, day_tz="UTC")
    return rounded(made, "predicted_price")


@query(
    "g11_long_walk_forward_per_hour",
    _long_sql(
        f"""SELECT p.zone, p.ts_utc, p.local_date, coalesce({_ridge()} * p.x, 0) AS predicted_price,
  p.y AS actual_price
FROM lp p JOIN usable u ON u.zone = p.zone AND u.fold = p.local_date
LEFT JOIN (SELECT zone, fold, hour, {_REGRESSION} FROM win GROUP BY zone, fold, hour
           HAVING count(*) >= 10) m ON m.zone = p.zone AND m.fold = p.local_date AND m.hour = p.hour"""
    ),
)
def _(spark, d):
    rows = market.long_series(spark, d)
    made = forecast.walk_forward(
        rows, PRICE, ["demand"], window_days=WINDOW, day_tz="UTC", per_hour=True
    )
    return rounded(made, "predicted_price")


_SINGLE = f"""SELECT p.zone, p.ts_utc, p.hour, {_ridge()} * p.x AS single, p.y AS y
FROM lp p JOIN (SELECT zone, fold, {_REGRESSION} FROM win JOIN usable USING (zone, fold)
                GROUP BY zone, fold) m ON m.zone = p.zone AND m.fold = p.local_date"""
_HOURLY = f"""SELECT p.zone, p.ts_utc, coalesce({_ridge()} * p.x, 0) AS per_hour
FROM lp p JOIN usable u ON u.zone = p.zone AND u.fold = p.local_date
LEFT JOIN (SELECT zone, fold, hour, {_REGRESSION} FROM win GROUP BY zone, fold, hour
           HAVING count(*) >= 10) m ON m.zone = p.zone AND m.fold = p.local_date AND m.hour = p.hour"""


@query(
    "g10_single_against_per_hour",
    "SELECT * REPLACE (round(mae_single, 6) AS mae_single, round(mae_per_hour, 6) AS mae_per_hour) FROM (\n"
    f"""WITH {_LONG}
SELECT *, CASE WHEN mae_single < mae_per_hour THEN 'Single' ELSE 'Per-Hour' END AS winner
FROM (SELECT zone, CAST(hour AS INTEGER) AS hour, avg(abs(y - single)) AS mae_single,
        avg(abs(y - per_hour)) AS mae_per_hour
      FROM ({_SINGLE}) JOIN ({_HOURLY}) USING (zone, ts_utc) GROUP BY 1, 2))""",
)
def _(spark, d):
    rows = market.long_series(spark, d)
    single, hourly = (
        forecast.walk_forward(rows, PRICE, ["demand"], window_days=WINDOW, day_tz="UTC", per_hour=per_hour)
        for per_hour in (False, True)
    )
    both = single.withColumnRenamed("predicted_price", "single").join(
        hourly.select("zone", "ts_utc", F.col("predicted_price").alias("per_hour")), ["zone", "ts_utc"]
    )
    return rounded(forecast.hourly_winner(both, "actual_price", "single", "per_hour", day_tz="UTC"))


def _long_matrix(spark, d):
    """Features of the long series, as a written table; boosted trees take rows with gaps."""
    rows = staged(market.long_series(spark, d), "long-series")
    matrix = features.feature_matrix(rows.select("zone", "ts_utc", PRICE))
    return staged(matrix.join(rows.select("zone", "ts_utc", "demand"), ["zone", "ts_utc"]), "long-matrix")


LONG_FEATURES = [*features.LAG_FEATURES, *features.CALENDAR_FEATURES, "demand"]


def _sampled_boosted(spark, d, per_hour: bool):
    matrix = _long_matrix(spark, d)
    dated = matrix.withColumn("local_date", local_date("ts_utc"))
    days = trading.sample_days(dated, 50, WINDOW)
    return boosting.walk_forward_boosted(
        matrix, PRICE, LONG_FEATURES, WINDOW, folds=days, per_hour=per_hour
    )


@query("g11_boosted_sampled")
def _(spark, d):
    return _sampled_boosted(spark, d, False)


@query("g11_boosted_sampled_per_hour")
def _(spark, d):
    return _sampled_boosted(spark, d, True)


def _hour_models(spark, d):
    rows = forecast.temporal_split(_long_matrix(spark, d))
    rows = staged(rows.withColumn("hour", local_hour("ts_utc")), "split-hours")
    models = boosting.fit_boosted(rows.where("is_train"), PRICE, LONG_FEATURES, ("zone", "hour"))
    return rows, staged(models, "hour-models")


@query("g03_boosted_per_hour")
def _(spark, d):
    rows, models = _hour_models(spark, d)
    test = rows.where("NOT is_train")
    scored = boosting.predict_boosted(models, test, LONG_FEATURES, ("zone", "hour"))
    return scored.select("zone", "ts_utc", F.col(PRICE).alias("actual_price"), "predicted_price")


@query("g05_mean_importance_over_hours")
def _(spark, d):
    return boosting.importance_table(_hour_models(spark, d)[1], LONG_FEATURES)
