import datetime as dt

import numpy as np
import pytest
import pandas as pd
from conftest import START, hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import features
from tidegrid.operators.align import to_grid


def test_lags_and_rolls_match_positional_reference(prices):
    df, pdf = prices(400)
    got = to_pandas(features.lag_features(df))
    for zone, g in pdf.groupby("zone"):
        p, out = g.price_eur_mwh.reset_index(drop=True), got[got.zone == zone].reset_index(drop=True)
        shifted = p.shift(24)
        want = {
            "price_lag_1d": shifted,
            "price_lag_2d": p.shift(48),
            "price_lag_7d": p.shift(168),
            "price_rolling_7d_mean": shifted.rolling(168, min_periods=24).mean(),
            "price_rolling_7d_std": shifted.rolling(168, min_periods=24).std(),
            "price_rolling_24h_min": shifted.rolling(24, min_periods=24).min(),
            "price_rolling_24h_max": shifted.rolling(24, min_periods=24).max(),
        }
        for name, values in want.items():
            np.testing.assert_allclose(out[name], values, rtol=1e-9, err_msg=name)
        assert out.price_lag_1d[24] == p[0]
        assert out.price_rolling_7d_mean[:47].isna().all() and out.price_rolling_7d_mean.notna()[47]


def test_gappy_series_equals_its_filled_grid(prices):
    df, _ = prices(300, drop=[30, 31, 100])
    direct = to_pandas(features.lag_features(df))
    grid = features.lag_features(to_grid(df, ["price_eur_mwh"]))
    via_grid = to_pandas(grid.where("price_eur_mwh IS NOT NULL"))
    pd.testing.assert_frame_equal(direct, via_grid)


def test_mixed_resolution_lag_is_24_hours(spark):
    # quarter-hourly rows: a positional shift of 24 would reach only 6 hours back
    ts = [START + dt.timedelta(minutes=15 * i) for i in range(4 * 48)]
    pdf = pd.DataFrame({"zone": "A", "ts_utc": ts, "price_eur_mwh": np.arange(192.0)})
    grid = to_grid(to_spark(spark, pdf), ["price_eur_mwh"])
    got = to_pandas(features.lag_features(grid))
    assert got.price_lag_1d[24] == got.price_eur_mwh[0] == 1.5


def test_calendar_uses_local_time_for_everything(spark):
    # 23:00 UTC on Friday is Saturday in Copenhagen; 24 Dec 23:30 UTC is 25 Dec there
    ts = [dt.datetime(2025, 1, 10, 23), dt.datetime(2024, 12, 24, 23), dt.datetime(2024, 12, 24, 22)]
    df = to_spark(spark, pd.DataFrame({"zone": "A", "ts_utc": ts}))
    got = to_pandas(features.calendar_features(df), "ts_utc")
    assert got.is_weekend.tolist() == [False, False, True]
    assert got.is_holiday.tolist() == [False, True, False]
    assert got.hour_sin[1] == 0 and got.hour_cos[1] == 1


def test_holiday_table_by_country(spark):
    df = to_spark(spark, pd.DataFrame({"zone": "A", "ts_utc": hours(24)}))
    table = spark.createDataFrame(
        [("DE", dt.date(2025, 1, 6)), ("DE", dt.date(2025, 1, 6))], "country string, date date"
    )
    assert features.calendar_features(df, holidays=table, country="DE").where("is_holiday").count() == 24
    assert features.calendar_features(df, holidays=table).where("is_holiday").count() == 0


def wind(series, n=60):
    return series(
        n,
        wind_onshore_mw=lambda r, n: np.where(r.random(n) < 0.2, np.nan, r.uniform(0, 100, n)),
        wind_offshore_mw=lambda r, n: r.uniform(0, 50, n),
        solar_mw=lambda r, n: r.uniform(0, 30, n),
    )


def test_wind_total_capacity_factor_and_error(series):
    df, pdf = wind(series)
    actual, apdf = series(60, seed=9, wind_actual_mw=lambda r, n: r.uniform(0, 150, n))
    got = to_pandas(features.wind_features(df, actual))
    for zone, g in pdf.groupby("zone"):
        out = got[got.zone == zone].reset_index(drop=True)
        total = g[["wind_onshore_mw", "wind_offshore_mw"]].sum(axis=1).reset_index(drop=True)
        peak = total.rolling(168, min_periods=24).max()
        np.testing.assert_allclose(out.wind_total_mw, total)
        np.testing.assert_allclose(out.wind_capacity_factor, np.where(peak > 0, total / peak, 0))
        error = apdf[apdf.zone == zone].wind_actual_mw.reset_index(drop=True) - total
        np.testing.assert_allclose(out.wind_forecast_error_lag1, error.shift(24))


def test_residual_load_of_misaligned_series(series):
    w, _ = wind(series, 10)
    load, _ = series(12, load_mw=lambda r, n: 3000 + r.random(n))
    got = to_pandas(features.residual_load(load, w))
    one = got[got.zone == "A"]
    assert len(one) == 12 and one.residual_load_mw.isna().tolist() == [False] * 10 + [True] * 2


def test_matrix_columns_and_complete_rows(prices, series):
    p, _ = prices(300, zones=("A", "B"))
    w, _ = wind(series, 300)
    load, _ = series(300, load_mw=lambda r, n: 3000 + r.random(n))
    only_a = lambda df: df.where("zone = 'A'")  # zone B is price-only
    full = features.feature_matrix(p, only_a(load), only_a(w))
    assert len(full.columns) == 2 + 19  # keys, then the 19-column matrix
    done = features.feature_matrix(p, only_a(load), only_a(w), complete=True)
    counts = {r.zone: r["count"] for r in done.groupBy("zone").count().collect()}
    assert counts == {"A": 300 - 168, "B": 300 - 168}
    stored = features.model_rows(full)
    assert stored.exceptAll(done).count() == 0 and stored.count() == done.count()
    warm = {r.zone: r.dropped for r in features.warm_up(full, done).collect()}
    assert warm == {"A": 168, "B": 168}


def test_price_only_matrix(prices):
    p, _ = prices(200)
    m = features.feature_matrix(p)
    assert features.feature_names(m) == [*features.LAG_FEATURES, *features.CALENDAR_FEATURES]


def test_flow_features(spark):
    edges = spark.createDataFrame([("A", "B", 50)], "from_zone string, to_zone string, capacity_mw int")
    pdf = pd.DataFrame({"from_zone": "A", "to_zone": "B", "ts_utc": hours(2), "flow_mw": [-25.0, 10.0]})
    flows = to_spark(spark, pdf)
    got = features.flow_features(flows, edges).orderBy("ts_utc").collect()
    assert [r.util_pct for r in got] == [50.0, 20.0]
    wide = features.flow_columns(flows, edges, [("A", "B")])
    assert set(wide.columns) == {"ts_utc", "flow_A_B_mw", "util_A_B_pct"}


def test_gate_closure(spark, prices):
    p, _ = prices(30)
    kept = features.gate_closure_features(features.feature_matrix(p))
    assert "price_lag_2d" in kept.columns and "price_lag_1d" not in kept.columns
    rules = spark.createDataFrame(list(features.FEATURE_AVAILABILITY.items()), "f string, a string")
    by_column = {r.f: r.k for r in rules.select("f", features.known_at_gate("a").alias("k")).collect()}
    assert by_column == {f: features._known(a, 12) for f, a in features.FEATURE_AVAILABILITY.items()}


def test_gate_closure_of_the_full_matrix(spark, prices):
    p, _ = prices(60, zones=("A", "B"))
    hourly = p.select("zone", "ts_utc")
    matrix = features.feature_matrix(
        p,
        load=hourly.selectExpr("zone", "ts_utc", "5D AS load_mw"),
        wind_solar=hourly.selectExpr("zone", "ts_utc", "1D AS wind_onshore_mw", "2D AS solar_mw"),
        actuals=hourly.selectExpr("zone", "ts_utc", "3D AS wind_actual_mw"),
        flows=hourly.where("zone = 'A'").selectExpr(
            "'A' AS from_zone", "'B' AS to_zone", "ts_utc", "4D AS flow_mw"),
        edges=spark.createDataFrame([("A", "B", 10)], "from_zone string, to_zone string, capacity_mw int"),
        flow_labels=[("A", "B")],
    )
    late = set(matrix.columns) - set(features.gate_closure_features(matrix).columns)
    assert late == {
        "price_lag_1d", "price_rolling_7d_mean", "price_rolling_7d_std", "price_rolling_24h_min",
        "price_rolling_24h_max", "wind_forecast_error_lag1", "flow_A_B_mw", "util_A_B_pct",
    }
    with pytest.raises(ValueError, match="surprise"):
        features.gate_closure_features(matrix.withColumn("surprise", matrix["load_mw"]))


def test_similar_day_rule(prices):
    df, pdf = prices(24 * 14, zones=("A",))
    got = to_pandas(features.similar_day(df))
    p = pdf.price_eur_mwh
    for i in range(24 * 7, 24 * 14):
        back = 168 if (i // 24) % 7 in (0, 5, 6) else 24  # the series starts on a Monday
        assert got.baseline[i] == p[i - back]


def test_volatility_and_look_ahead(prices):
    df, pdf = prices(200, zones=("A",))
    vol = to_pandas(features.rolling_volatility(df))
    want = pdf.price_eur_mwh.rolling(168, min_periods=24).std()
    np.testing.assert_allclose(vol.rolling_7d_std, want, rtol=1e-9)
    row = features.look_ahead_demo(df).first()
    p = pdf.price_eur_mwh
    r1, r24 = p.corr(p.shift(1)), p.corr(p.shift(24))
    np.testing.assert_allclose([row.r_1h, row.r_24h, row.inflation_pct], [r1, r24, (r1 / r24 - 1) * 100])
