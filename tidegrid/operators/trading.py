"""Signals, P&L, risk figures and earnings on a predictions table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.stats import ratio_or_limit
from tidegrid.functions.time import MARKET_TZ, local_date, local_hour
from tidegrid.operators.align import dedup, fold_days
from tidegrid.operators.blocks import day_carry, running

# Strategy, fee and reporting defaults.
N_LONG = N_SHORT = 4
POSITION_MWH = 1.0
FEE_EUR_MWH = 0.04
THRESHOLDS = (2.0, 5.0, 8.0, 12.0, 15.0)
SCENARIOS = (("conservative", 0.4), ("base", 0.6), ("optimistic", 0.8))
SCENARIO_FEE_EUR_MWH = 0.15
EUR_TO_DKK = 7.46
REPORT_POSITION_MWH = 10.0
DEFAULT_ANNUAL_COST = 30_000.0
YEAR_DAYS = 365


def sample_days(
    df: DataFrame, k: int, window_days: int, day: str = "local_date", by: Sequence[str] = ("zone",)
) -> DataFrame:
    """At most ``k`` evenly spaced test days per zone (truncated spacing)."""
    eligible = fold_days(df, day, window_days, by)
    w = Window.partitionBy(*by)
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.floor(i * ((F.col("_n") - 1) / F.lit(float(max(k - 1, 1))))),
    )
    numbered = eligible.withColumn(
        "_i", F.row_number().over(w.orderBy("fold_day")) - 1
    ).withColumn("_n", F.count(F.lit(1)).over(w))
    keep = (F.col("_n") <= k) | F.array_contains(spaced, F.col("_i").cast("bigint"))
    return numbered.where(keep).select(*by, "fold_day")


def unscored_days(
    days: DataFrame, scored: DataFrame, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Days without stored results."""
    done = scored.select(*by, F.col("local_date").alias("fold_day")).distinct()
    return days.join(done, [*by, "fold_day"], "left_anti")


def merge_results(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and new hourly results; on a shared hour the new row wins."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return dedup(both, "_seq", "last").drop("_seq").select(*stored.columns)


def rank_spread(
    df: DataFrame,
    n_long: int = N_LONG,
    n_short: int = N_SHORT,
    position_mwh: float = POSITION_MWH,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Buy the cheapest and sell the dearest predicted hours of each day.

    Ties go to the earlier hour on both sides, and an hour that qualifies for
    both is sold. Days with fewer rows than both sides need get no position.
    Adds ``local_date`` and ``position``.
    """
    rows = df.withColumn("local_date", local_date("ts_utc", day_tz))
    keys = [*by, "local_date"]
    day = Window.partitionBy(*keys)
    cheap = F.row_number().over(day.orderBy(F.asc("predicted_price"), "ts_utc"))
    dear = F.row_number().over(day.orderBy(F.desc("predicted_price"), "ts_utc"))
    numbered = rows.withColumn("_cheap", cheap).withColumn("_dear", dear).withColumn(
        "_n", F.count(F.lit(1)).over(day)
    )
    position = (
        F.when(F.col("_n") < n_long + n_short, F.lit(0.0))
        .when(F.col("_dear") <= n_short, F.lit(-float(position_mwh)))
        .when(F.col("_cheap") <= n_long, F.lit(float(position_mwh)))
        .otherwise(F.lit(0.0))
    )
    return numbered.withColumn("position", position).drop("_cheap", "_dear", "_n")


def _threshold_position(diff, threshold, position_mwh: float):
    return (
        F.when(diff > threshold, F.lit(float(position_mwh)))
        .when(diff < -threshold, F.lit(-float(position_mwh)))
        .otherwise(F.lit(0.0))
    )


def threshold_signals(
    df: DataFrame,
    baseline_col: str,
    threshold_eur: float = 5.0,
    position_mwh: float = POSITION_MWH,
    max_daily_trades: int | None = None,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Long above baseline + threshold, short below baseline − threshold.

    With ``max_daily_trades`` only the largest absolute differences of a day
    stay active; ties go to the earlier hour.
    """
    diff = F.col("predicted_price") - F.col(baseline_col)
    rows = df.withColumn("local_date", local_date("ts_utc", day_tz)).withColumn(
        "position", _threshold_position(diff, F.lit(float(threshold_eur)), position_mwh)
    )
    if max_daily_trades is None:
        return rows
    active = F.col("position") != 0
    order = Window.partitionBy(*by, "local_date").orderBy(
        F.desc(active.cast("int")), F.desc(F.abs(diff)), "ts_utc"
    )
    return (
        rows.withColumn("_rank", F.row_number().over(order))
        .withColumn(
            "position",
            F.when(F.col("_rank") <= max_daily_trades, F.col("position")).otherwise(F.lit(0.0)),
        )
        .drop("_rank")
    )


def pnl(
    df: DataFrame, cost: float = FEE_EUR_MWH, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``pnl = −position·(actual − day mean) − |position|·cost``."""
    day_mean = F.avg("actual_price").over(Window.partitionBy(*by, "local_date"))
    gross = -F.col("position") * (F.col("actual_price") - day_mean)
    return df.withColumn("pnl", gross - F.abs("position") * F.lit(float(cost)))


# ----------------------------------------------------------------------- risk


def daily_pnl(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return results.groupBy(*by, "local_date").agg(F.sum("pnl").alias("pnl"))


def daily_pnl_stats(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return daily_pnl(results, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("daily_pnl_mean"),
        F.stddev_samp("pnl").alias("daily_pnl_std"),
    )


def drawdown_curve(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Cumulative P&L, its running peak (from the first value, not from 0) and
    the drawdown at every hour."""
    curve = running(results, "pnl", by, "local_date")
    return curve.withColumn("drawdown", F.col("peak") - F.col("cumulative"))


def _day_folds(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per day holding everything the risk figures need of its hours."""
    inside = (
        Window.partitionBy(*by, "local_date")
        .orderBy("ts_utc")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    path = results.withColumn("_c", F.sum("pnl").over(inside)).withColumn(
        "_dd", F.max("_c").over(inside) - F.col("_c")
    )
    traded = F.col("position") != 0
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    days = path.groupBy(*by, "local_date").agg(
        F.sum("pnl").alias("day_pnl"),
        F.max("_c").alias("_top"),
        F.min("_c").alias("_low"),
        F.max("_dd").alias("_dd"),
        F.count_if(traded).alias("n_trades"),
        F.count_if(traded & win).alias("n_wins"),
        F.count_if(traded & loss).alias("n_losses"),
        F.sum(F.when(traded & win, F.col("pnl"))).alias("won"),
        F.sum(F.when(traded & loss, F.col("pnl"))).alias("lost"),
        F.sum(F.when(win, F.col("pnl"))).alias("gross_win"),
        F.sum(F.when(loss, -F.col("pnl"))).alias("gross_loss"),
    )
    return day_carry(days, by, "local_date", "day_pnl", "_top").withColumn(
        "drawdown",
        F.greatest(
            F.col("_dd"), F.col("earlier_peak") - (F.col("offset") + F.col("_low"))
        ),
    )


def backtest_summary(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Thirteen performance figures per zone.

    Hours fold into day rows first; drawdown combines day rows by carrying the
    earlier peak, so no task ever holds a whole hourly series.
    """
    day = F.col("day_pnl")
    downside = F.when(day < 0, day)
    agg = _day_folds(results, by).groupBy(*by).agg(
        F.sum(day).alias("total_pnl"),
        F.avg(day).alias("daily_pnl_mean"),
        F.stddev_samp(day).alias("daily_pnl_std"),
        F.stddev_samp(downside).alias("_down_std"),
        F.count(downside).alias("_n_down"),
        F.max("drawdown").alias("max_drawdown"),
        F.sum("n_trades").alias("n_trades"),
        F.count(F.lit(1)).alias("n_trading_days"),
        F.sum("n_wins").alias("_wins"),
        F.sum("n_losses").alias("_losses"),
        F.coalesce(F.sum("won"), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum("lost"), F.lit(0.0)).alias("_lost"),
        F.coalesce(F.sum("gross_win"), F.lit(0.0)).alias("_gross_win"),
        F.coalesce(F.sum("gross_loss"), F.lit(0.0)).alias("_gross_loss"),
    )
    mean = F.col("daily_pnl_mean")
    yearly = F.lit(math.sqrt(YEAR_DAYS))
    annual = F.col("total_pnl") * (F.lit(float(YEAR_DAYS)) / F.col("n_trading_days"))
    down = F.when(F.col("_n_down") == 0, F.lit(0.0)).otherwise(F.col("_down_std"))
    non_zero = F.col("_wins") + F.col("_losses")

    def mean_or_zero(total: str, n: str):
        return F.when(F.col(n) == 0, F.lit(0.0)).otherwise(
            F.col(total) / F.nullif(F.col(n), F.lit(0))
        )

    return agg.select(
        *by,
        "total_pnl",
        "daily_pnl_mean",
        "daily_pnl_std",
        (ratio_or_limit(mean, F.col("daily_pnl_std"), mean) * yearly).alias("sharpe_ratio"),
        (ratio_or_limit(mean, down, mean) * yearly).alias("sortino_ratio"),
        ratio_or_limit(annual, F.col("max_drawdown"), annual).alias("calmar_ratio"),
        ratio_or_limit(F.col("_gross_win"), F.col("_gross_loss"), F.col("_gross_win")).alias(
            "profit_factor"
        ),
        "max_drawdown",
        F.when(non_zero == 0, F.lit(0.0))
        .otherwise(F.col("_wins") * 100.0 / F.nullif(non_zero, F.lit(0)))
        .alias("win_rate_pct"),
        "n_trades",
        "n_trading_days",
        mean_or_zero("_won", "_wins").alias("avg_win"),
        mean_or_zero("_lost", "_losses").alias("avg_loss"),
    )


def max_drawdown(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return _day_folds(results, by).groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"))


def sharpe_ratio(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return backtest_summary(results, by).select(*by, "sharpe_ratio")


def sortino_ratio(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return backtest_summary(results, by).select(*by, "sortino_ratio")


def calmar_ratio(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return backtest_summary(results, by).select(*by, "calmar_ratio")


def profit_factor(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return backtest_summary(results, by).select(*by, "profit_factor")


def win_rate(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return backtest_summary(results, by).select(*by, "win_rate_pct")


def pnl_by_hour(
    results: DataFrame, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    return results.groupBy(*by, local_hour("ts_utc", day_tz).alias("hour")).agg(
        F.sum("pnl").alias("pnl")
    )


def pnl_by_month(results: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    month = F.date_format("local_date", "yyyy-MM").alias("month")
    return results.groupBy(*by, month).agg(F.sum("pnl").alias("pnl"))


def threshold_sweep(
    df: DataFrame,
    baseline_col: str,
    thresholds: Sequence[float] = THRESHOLDS,
    cost: float = 0.0,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Back-test figures for each threshold, all in one plan.

    Every hour is emitted once per threshold (a fixed short list) and the
    threshold joins the group keys.
    """
    keys = [*by, "threshold_eur"]
    diff = F.col("predicted_price") - F.col(baseline_col)
    fan = df.withColumn("local_date", local_date("ts_utc", day_tz)).withColumn(
        "threshold_eur", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    )
    rows = fan.withColumn(
        "position", _threshold_position(diff, F.col("threshold_eur"), POSITION_MWH)
    )
    summary = backtest_summary(pnl(rows, cost, keys), keys)
    return summary.select(
        *keys, "total_pnl", "sharpe_ratio", "win_rate_pct", "n_trades", "max_drawdown"
    )


# ------------------------------------------------------------------- earnings


def earnings(
    summary: DataFrame,
    costs: DataFrame,
    position_mwh: float = REPORT_POSITION_MWH,
    default_cost: float = DEFAULT_ANNUAL_COST,
) -> DataFrame:
    """Annualised earnings at position size, after 50 % and 25 % haircuts and
    the yearly cost of the zone. ``costs`` is ``zone, label, annual_cost``."""
    gross = F.col("total_pnl") * position_mwh * (F.lit(float(YEAR_DAYS)) / F.col("n_trading_days"))
    return (
        summary.select("zone", "total_pnl", "n_trading_days", gross.alias("gross_annual"))
        .withColumn("after_haircut_50pct", F.col("gross_annual") * 0.50)
        .withColumn("after_haircut_25pct", F.col("gross_annual") * 0.25)
        .join(costs.select("zone", "label", "annual_cost"), "zone", "left")
        .withColumn("annual_cost", F.coalesce("annual_cost", F.lit(default_cost)).cast("double"))
        .withColumn("net_base_case", F.col("after_haircut_50pct") - F.col("annual_cost"))
        .withColumn("net_conservative", F.col("after_haircut_25pct") - F.col("annual_cost"))
    )


def profit_scenarios(
    summary: DataFrame,
    position_mwh: float = REPORT_POSITION_MWH,
    fee: float = SCENARIO_FEE_EUR_MWH,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Yearly and monthly profit in EUR and DKK under three haircuts, net of
    annualised trading fees."""
    factor = F.lit(float(YEAR_DAYS)) / F.col("n_trading_days")
    net = (
        F.col("total_pnl") * position_mwh * factor
        - F.col("n_trades") * factor * fee * position_mwh
    )
    choices = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("kept")) for n, k in SCENARIOS]
    )
    annual = F.col("_net") * F.col("_s.kept")
    return (
        summary.select(*by, net.alias("_net"), F.explode(choices).alias("_s"))
        .select(
            *by,
            "_s.scenario",
            annual.alias("annual_eur"),
            (annual * EUR_TO_DKK).alias("annual_dkk"),
            (annual / 12).alias("monthly_eur"),
            (annual / 12 * EUR_TO_DKK).alias("monthly_dkk"),
        )
    )
