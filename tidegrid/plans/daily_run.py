"""The full daily run over all zones: quality, features, model, back-test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.time import MARKET_TZ
from tidegrid.operators import boosting, features, forecast, monitor, quality, trading
from tidegrid.operators.align import concat
from tidegrid.session import staged
from tidegrid.sources.store import write_report

# Training windows in days, with and without fundamentals.
WINDOW_FULL, WINDOW_PRICE_ONLY = 56, 30


def prepare(
    tables: dict[str, tuple[DataFrame, Sequence[str]]],
    order: str = "ingest_no",
    day_tz: str = MARKET_TZ,
) -> dict[str, DataFrame]:
    """Clean tables, zone quality and the complete feature matrix of all zones
    that pass the gate. Cleaned tables and checks are written once, since both
    the checks and the features read them."""
    cleaned = quality.load_all(tables, order)
    data = {name: staged(df, name) for name, df in cleaned.items()}
    checks = staged(
        quality.zone_quality(
            data["prices"], data["wind_solar"], data["load"], data["imputation_log"], day_tz
        ),
        "quality",
    )
    kept = {
        name: quality.passing_zones(data[name], checks)
        for name in ("prices", "wind_solar", "load")
    }
    matrix = features.feature_matrix(
        kept["prices"], kept["load"], kept["wind_solar"], day_tz=day_tz, complete=True
    )
    return {**data, "quality": checks, "matrix": matrix}


def feature_sets(matrix: DataFrame) -> list[tuple[DataFrame, list[str], int]]:
    """(rows, feature names, training window) of the zones with fundamentals
    and of the price-only zones. After the ``complete`` rule a row misses a
    column only if its whole zone does."""
    names = features.feature_names(matrix)
    basic = [*features.LAG_FEATURES, *features.CALENDAR_FEATURES]
    if set(names) == set(basic):
        return [(matrix, basic, WINDOW_PRICE_ONLY)]
    lacking = F.greatest(*[F.col(c).isNull() for c in names])
    return [
        (matrix.where(~lacking), names, WINDOW_FULL),
        (matrix.where(lacking), basic, WINDOW_PRICE_ONLY),
    ]


def evaluate_split(
    matrix: DataFrame,
    names: Sequence[str],
    params: dict | None = None,
    day_tz: str = MARKET_TZ,
) -> tuple[DataFrame, DataFrame]:
    """70/30 split, one model, test metrics per zone and feature importance."""
    rows = forecast.temporal_split(matrix)
    model = forecast.fit_gbt(rows.where("is_train"), features.PRICE, names, params)
    scored = forecast.score(model, rows.where(~F.col("is_train")), names)
    metrics = forecast.evaluate(scored, features.PRICE, "predicted_price").join(
        forecast.rank_correlation(scored, features.PRICE, "predicted_price", day_tz), "zone", "left"
    )
    return metrics, forecast.importance(model, matrix, names)


def backtest(
    matrix: DataFrame,
    names: Sequence[str],
    window_days: int = WINDOW_FULL,
    day_tz: str = MARKET_TZ,
    folds: DataFrame | None = None,
    learner: str = "ridge",
    per_hour: bool = False,
    settings: boosting.Settings | None = None,
) -> DataFrame:
    """Walk-forward forecasts, rank-spread positions and hourly P&L.

    ``learner`` is ``ridge`` or ``boosted`` (trees with ``settings``).
    """
    common = {"day_tz": day_tz, "folds": folds, "per_hour": per_hour}
    if learner == "boosted":
        made = boosting.walk_forward_boosted(
            matrix, features.PRICE, names, window_days, settings=settings, **common
        )
    elif learner == "ridge":
        made = forecast.walk_forward(matrix, features.PRICE, names, window_days, **common)
    else:
        raise ValueError(f"unknown learner {learner!r}")
    return trading.pnl(trading.rank_spread(made.drop("local_date"), day_tz=day_tz))


def run(
    tables: dict[str, tuple[DataFrame, Sequence[str]]],
    out: str,
    run_at: str,
    order: str = "ingest_no",
    window_days: int | None = None,
    params: dict | None = None,
    day_tz: str = MARKET_TZ,
) -> DataFrame:
    """The whole run; every stage's table is written under ``out`` and later
    stages read it from there. Returns the back-test summary per zone."""
    spark = tables["prices"][0].sparkSession
    data = prepare(tables, order, day_tz)
    write_report(data["imputation_log"], f"{out}/imputation_audit", "csv")
    write_report(data["quality"], f"{out}/quality", "json")
    write_report(data["matrix"], f"{out}/matrix", "parquet")
    matrix = spark.read.parquet(f"{out}/matrix")
    groups = [g for g in feature_sets(matrix) if not g[0].isEmpty()]

    evaluated = [evaluate_split(rows, names, params, day_tz) for rows, names, _ in groups]
    write_report(concat(*[m for m, _ in evaluated]), f"{out}/metrics", "parquet")
    write_report(concat(*[i for _, i in evaluated]), f"{out}/importance", "csv")
    observed = spark.read.parquet(f"{out}/metrics").select(
        "zone", F.lit(run_at).cast("timestamp_ntz").alias("ts_utc"), "mae"
    )
    monitor.append_observation(f"{out}/error_history", observed)
    drift = monitor.drift_status(spark.read.parquet(f"{out}/error_history"))
    write_report(drift, f"{out}/drift", "json")

    scored = [
        backtest(rows, names, window_days or window, day_tz) for rows, names, window in groups
    ]
    write_report(concat(*scored), f"{out}/results", "parquet")
    summary = trading.backtest_summary(spark.read.parquet(f"{out}/results"))
    write_report(summary, f"{out}/summary", "json")
    return summary
