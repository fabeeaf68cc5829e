"""Model-error history and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.blocks import trailing_rows

SHORT, LONG = 7, 30  # observations, not days


def append_observation(path: str, observations: DataFrame) -> None:
    """Append ``zone, ts_utc, mae`` rows to the history table."""
    observations.select("zone", "ts_utc", "mae").write.mode("append").parquet(path)


def _message(n: Column, short: Column, long: Column, drifting: Column) -> Column:
    zone = F.col("zone")
    return (
        F.when(
            drifting,
            F.format_string(
                "DRIFT DETECTED for %s: 7-day MAE (%.2f) exceeds 2x 30-day MAE (%.2f)",
                zone, short, long,
            ),
        )
        .when(
            n < SHORT,
            F.format_string(
                "%s: not enough history for drift detection (%d observations)", zone, n
            ),
        )
        .otherwise(
            F.format_string(
                "%s: model performance stable (7d=%.2f, 30d=%.2f)", zone, short, long
            )
        )
    )


def drift_status(history: DataFrame) -> DataFrame:
    """Latest status per zone: mean of the last 7 against twice the mean of the
    last 30 observations. With errors ≥ 0 it can only fire from 15 on.

    The rank filter keeps at most 30 rows per zone and task before the shuffle.
    """
    latest = Window.partitionBy("zone").orderBy(F.desc("ts_utc"))
    counts = history.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    recent = (
        history.withColumn("_k", F.row_number().over(latest))
        .where(F.col("_k") <= LONG)
        .groupBy("zone")
        .agg(
            F.max(F.when(F.col("_k") == 1, F.col("mae"))).alias("current_mae"),
            F.avg(F.when(F.col("_k") <= SHORT, F.col("mae"))).alias("_short"),
            F.avg("mae").alias("_long"),
        )
        .join(counts, "zone")
    )
    short, long, n = F.col("_short"), F.col("_long"), F.col("n")
    drifting = (n >= SHORT) & (short > long * 2)
    return recent.select(
        "zone",
        "current_mae",
        F.round(short, 4).alias("rolling_7d_mae"),
        F.round(long, 4).alias("rolling_30d_mae"),
        drifting.alias("is_drifting"),
        _message(n, short, long, drifting).alias("message"),
    )


def drift_history(history: DataFrame) -> DataFrame:
    """Both means (unrounded) and the drift flag as of each observation."""

    def build(w):
        short, long = w.rowsBetween(-(SHORT - 1), 0), w.rowsBetween(-(LONG - 1), 0)
        return {
            "_short": F.avg("mae").over(short),
            "_long": F.avg("mae").over(long),
            "_n": F.count("mae").over(short),
        }

    rows = trailing_rows(history, LONG - 1, build)
    return rows.select(
        "zone",
        "ts_utc",
        "mae",
        F.col("_short").alias("rolling_7d_mae"),
        F.col("_long").alias("rolling_30d_mae"),
        ((F.col("_n") >= SHORT) & (F.col("_short") > F.col("_long") * 2)).alias("is_drifting"),
    )
