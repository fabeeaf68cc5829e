"""Back-test on evenly spaced days, filling in only days not yet scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.time import MARKET_TZ, local_date
from tidegrid.operators import trading
from tidegrid.operators.boosting import Settings
from tidegrid.plans.daily_run import WINDOW_FULL, backtest
from tidegrid.session import staged


def stored_results(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def run(
    matrix: DataFrame,
    names: Sequence[str],
    results_path: str,
    n_samples: int = 50,
    window_days: int = WINDOW_FULL,
    day_tz: str = MARKET_TZ,
    refresh: bool = False,
    zones: DataFrame | None = None,
    learner: str = "ridge",
    settings: Settings | None = None,
) -> DataFrame:
    """Score the sampled days of every zone that have no stored result, add
    them to the result table and return the summary per zone. ``matrix`` is
    read several times: pass a stored table.

    Only new days are computed and written; stored ones stay as they are. The
    summary has one row per zone of ``zones`` (default: those of the matrix)
    with ``status`` ok, ``no_results`` (no day could be scored) or ``no_data``
    (no matrix rows), and counts the days sampled, found stored and new.
    """
    spark = matrix.sparkSession
    dated = matrix.withColumn("local_date", local_date("ts_utc", day_tz))
    days = staged(trading.sample_days(dated, n_samples, window_days), "sampled-days")
    stored = None if refresh else stored_results(spark, results_path)
    todo = days if stored is None else trading.unscored_days(days, stored)
    todo = staged(todo, "unscored-days")
    cached = None
    if stored is not None:  # counted before the table grows
        cached = stored.groupBy("zone").agg(F.count_distinct("local_date").alias("n_cached"))
        cached = staged(cached, "cached-days")
    fresh = backtest(matrix, names, window_days, day_tz, folds=todo, learner=learner, settings=settings)
    # staged first: a job that fails leaves the result table as it was
    staged(fresh, "results").write.mode("overwrite" if refresh else "append").parquet(results_path)
    results = spark.read.parquet(results_path)
    counts = [
        results.groupBy("zone").agg(F.count_distinct("local_date").alias("n_test_days")),
        days.groupBy("zone").agg(F.count(F.lit(1)).alias("n_sampled")),
        todo.groupBy("zone").agg(F.count(F.lit(1)).alias("n_new")),
        *([] if cached is None else [cached]),
    ]
    present = matrix.select("zone").distinct().withColumn("_present", F.lit(True))
    out = present if zones is None else zones.select("zone").distinct().join(present, "zone", "left")
    for part in (trading.backtest_summary(results), *counts):
        out = out.join(part, "zone", "left")
    if cached is None:
        out = out.withColumn("n_cached", F.lit(0).cast("bigint"))
    status = (
        F.when(F.col("_present").isNull(), "no_data")
        .when(F.col("n_test_days").isNull(), "no_results").otherwise("ok")
    )
    out = out.withColumn("status", status).drop("_present")
    return out.na.fill(0, ["n_test_days", "n_sampled", "n_new", "n_cached"])
