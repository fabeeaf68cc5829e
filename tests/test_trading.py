import math

import numpy as np
import pandas as pd
import pytest
from conftest import hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import monitor, trading


def predictions(spark, predicted, actual=None, zone="A"):
    n = len(predicted)
    return to_spark(
        spark,
        pd.DataFrame(
            {"zone": zone, "ts_utc": hours(n), "predicted_price": np.asarray(predicted, float),
             "actual_price": np.asarray(predicted if actual is None else actual, float)}
        ),
    )


def test_rank_spread_places_four_and_four(spark):
    got = to_pandas(trading.rank_spread(predictions(spark, range(24))))
    assert got.position.tolist() == [1.0] * 4 + [0.0] * 16 + [-1.0] * 4


def test_equal_predictions_give_shorts_only(spark):
    got = to_pandas(trading.rank_spread(predictions(spark, [5] * 24)))
    assert got.position.tolist() == [-1.0] * 4 + [0.0] * 20


def test_short_days_stay_flat(spark):
    assert trading.rank_spread(predictions(spark, range(7))).where("position <> 0").count() == 0
    assert trading.rank_spread(predictions(spark, range(8))).where("position <> 0").count() == 8


def test_pnl_and_cost(spark):
    signals = trading.rank_spread(predictions(spark, range(24)))
    free, paid = (to_pandas(trading.pnl(signals, c)).pnl for c in (0.0, 0.5))
    assert free[0] == pytest.approx(11.5) and free[23] == pytest.approx(11.5)
    assert (free - paid).sum() == pytest.approx(4.0)


def test_threshold_signals_and_cap(spark):
    df = predictions(spark, [10, 20, 0, 11, 30, 10]).withColumn("base", F.lit(10.0))
    got = to_pandas(trading.threshold_signals(df, "base")).position.tolist()
    assert got == [0.0, 1.0, -1.0, 0.0, 1.0, 0.0]
    capped = to_pandas(trading.threshold_signals(df, "base", max_daily_trades=2)).position.tolist()
    assert capped == [0.0, 1.0, 0.0, 0.0, 1.0, 0.0]  # tie at 10: the earlier hour stays


def results(spark, pnl, position=None):
    n = len(pnl)
    pdf = pd.DataFrame(
        {"zone": "A", "ts_utc": hours(n), "pnl": np.asarray(pnl, float),
         "position": np.asarray(position if position is not None else np.sign(pnl), float)}
    )
    df = to_spark(spark, pdf)
    from tidegrid.functions.time import local_date

    return df.withColumn("local_date", local_date("ts_utc")), pdf


def test_drawdown_starts_at_the_first_value(spark):
    steps = np.diff([0, 10, 15, 8, 12])
    df, _ = results(spark, steps)
    assert trading.max_drawdown(df).first().max_drawdown == pytest.approx(7.0)
    df, _ = results(spark, [-5.0, 2.0, -1.0])
    assert trading.max_drawdown(df).first().max_drawdown == pytest.approx(1.0)


def test_summary_against_pandas(spark):
    rng = np.random.default_rng(5)
    pnl = np.where(rng.random(24 * 20) < 0.5, 0.0, rng.normal(0.3, 2, 480))
    df, pdf = results(spark, pnl)
    row = trading.backtest_summary(df).first()
    day = (pdf.ts_utc + pd.Timedelta(hours=1)).dt.date
    daily = pdf.pnl.groupby(day).sum()
    cum = pdf.pnl.cumsum()
    mdd = (cum.cummax() - cum).max()
    trades = pdf.pnl[pdf.position != 0]
    want = {
        "total_pnl": pnl.sum(), "daily_pnl_mean": daily.mean(), "daily_pnl_std": daily.std(),
        "sharpe_ratio": daily.mean() / daily.std() * math.sqrt(365),
        "sortino_ratio": daily.mean() / daily[daily < 0].std() * math.sqrt(365),
        "calmar_ratio": daily.sum() * 365 / len(daily) / mdd,
        "profit_factor": trades[trades > 0].sum() / -trades[trades < 0].sum(),
        "max_drawdown": mdd, "win_rate_pct": 100 * (trades > 0).mean(),
        "n_trades": len(trades), "n_trading_days": len(daily),
        "avg_win": trades[trades > 0].mean(), "avg_loss": trades[trades < 0].mean(),
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value), name
    curve = to_pandas(trading.drawdown_curve(df))
    np.testing.assert_allclose(curve.drawdown, cum.cummax() - cum, atol=1e-9)


def test_edge_cases_are_inf_zero_or_null(spark):
    gain = trading.backtest_summary(results(spark, [1.0] * 48)[0]).first()
    assert math.isinf(gain.sharpe_ratio) and math.isinf(gain.sortino_ratio)
    assert math.isinf(gain.calmar_ratio) and math.isinf(gain.profit_factor)
    flat = trading.backtest_summary(results(spark, [0.0] * 48)[0]).first()
    assert (flat.sharpe_ratio, flat.profit_factor, flat.win_rate_pct, flat.avg_win) == (0, 0, 0, 0)
    one = trading.backtest_summary(results(spark, [1.0, -0.5])[0]).first()
    assert one.sharpe_ratio is None and one.n_trading_days == 1
    loss = trading.backtest_summary(results(spark, [-1.0] * 48)[0]).first()
    assert (loss.sharpe_ratio, loss.sortino_ratio, loss.avg_loss) == (0.0, 0.0, -1.0)


def test_sampled_days_follow_truncated_spacing(spark):
    df, _ = results(spark, np.zeros(24 * 40))
    got = sorted(r.fold_day for r in trading.sample_days(df, 7, 10).collect())
    days = sorted(r.local_date for r in df.select("local_date").distinct().collect())[10:]
    want = [days[i] for i in np.linspace(0, len(days) - 1, 7, dtype=int)]
    assert got == want
    assert trading.sample_days(df, 100, 10).count() == len(days)


def test_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(2)
    df = predictions(spark, rng.normal(50, 10, 96), rng.normal(50, 10, 96)).withColumn(
        "base", F.lit(50.0)
    )
    swept = {r.threshold_eur: r for r in trading.threshold_sweep(df, "base", [2.0, 12.0]).collect()}
    for t, row in swept.items():
        one = trading.backtest_summary(
            trading.pnl(trading.threshold_signals(df, "base", t), 0.0)
        ).first()
        assert row.total_pnl == pytest.approx(one.total_pnl) and row.n_trades == one.n_trades


def test_earnings_and_scenarios(spark):
    summary = spark.createDataFrame(
        [("A", 100.0, 50, 400), ("X", 10.0, 73, 10)],
        "zone string, total_pnl double, n_trading_days long, n_trades long",
    )
    costs = spark.createDataFrame([("A", "Zone A", 15000.0)], "zone string, label string, annual_cost double")
    rows = {r.zone: r for r in trading.earnings(summary, costs).collect()}
    assert rows["A"].gross_annual == pytest.approx(7300)
    assert rows["A"].net_base_case == pytest.approx(3650 - 15000)
    assert rows["X"].annual_cost == 30000 and rows["X"].label is None
    base = trading.profit_scenarios(summary).where("zone = 'A' AND scenario = 'base'").first()
    net = 100 * 10 * 7.3 - 400 * 7.3 * 0.15 * 10
    assert base.annual_eur == pytest.approx(net * 0.6)
    assert base.monthly_dkk == pytest.approx(net * 0.6 / 12 * 7.46)


def history(spark, maes):
    return to_spark(spark, pd.DataFrame({"zone": "A", "ts_utc": hours(len(maes)), "mae": np.asarray(maes, float)}))


def test_drift_needs_more_than_fourteen_observations(spark):
    spike14 = [0.0] * 7 + [10.0] * 7
    assert not monitor.drift_status(history(spark, spike14)).first().is_drifting
    row = monitor.drift_status(history(spark, [0.0] * 8 + [10.0] * 7)).first()
    assert row.is_drifting and row.message.startswith("DRIFT DETECTED for A: 7-day MAE (10.00)")
    few = monitor.drift_status(history(spark, [1.0] * 3)).first()
    assert "not enough history" in few.message and few.current_mae == 1.0
    stable = monitor.drift_status(history(spark, [1.0] * 40)).first()
    assert stable.message == "A: model performance stable (7d=1.00, 30d=1.00)"


def test_drift_history_ends_at_status(spark):
    h = history(spark, [0.0] * 30 + [10.0] * 7)
    last = h.sparkSession.createDataFrame(
        monitor.drift_history(h).orderBy(F.desc("ts_utc")).take(1)
    ).first()
    assert last.is_drifting == monitor.drift_status(h).first().is_drifting is True
