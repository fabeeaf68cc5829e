import datetime as dt

import numpy as np
import pandas as pd
from conftest import START, hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import quality


def test_long_gap_fills_only_its_first_rows(spark):
    values = [1.0] + [np.nan] * 8 + [5.0]
    pdf = pd.DataFrame({"zone": "A", "ts_utc": hours(10), "v": values})
    filled, audit = quality.impute_ffill(to_spark(spark, pdf), ["v"], limit=6)
    got = to_pandas(filled).v
    np.testing.assert_array_equal(got, pd.Series(values).ffill(limit=6))
    assert audit.count() == 6
    row = audit.first()
    assert (row.column, row.method) == ("v", "ffill (max 6h)")


def test_fill_counts_rows_not_hours_and_stays_in_its_zone(spark):
    ts = [START, START + dt.timedelta(days=40), START + dt.timedelta(days=41)]
    pdf = pd.DataFrame(
        {"zone": ["A"] * 3 + ["B"] * 3, "ts_utc": ts * 2, "v": [1.0, np.nan, 2.0] + [np.nan] * 3}
    )
    filled = to_pandas(quality.impute_ffill(to_spark(spark, pdf), ["v"])[0])
    assert filled.v.tolist()[:3] == [1.0, 1.0, 2.0] and filled.v[3:].isna().all()


def test_load_all_cleans_and_aligns(spark, series):
    p, _ = series(20, price_eur_mwh=lambda r, n: r.normal(size=n))
    w, _ = series(24, wind_onshore_mw=lambda r, n: np.r_[np.nan, r.random(n - 1)])
    tables = {
        "prices": (p.withColumn("ingest_no", F.lit(1)), ["price_eur_mwh"]),
        "wind_solar": (w.withColumn("ingest_no", F.lit(1)), ["wind_onshore_mw"]),
    }
    out = quality.load_all(tables)
    assert out["wind_solar"].where("zone = 'A'").count() == 19  # first hour stays NULL
    assert out["imputation_log"].count() == 0


def outliers(spark, values, **kw):
    pdf = pd.DataFrame({"zone": "A", "ts_utc": hours(len(values)), "price_eur_mwh": values})
    return to_pandas(quality.detect_outliers(to_spark(spark, pdf), **kw))


def test_outlier_rules(spark):
    rng = np.random.default_rng(0)
    base = 50 + rng.normal(0, 1, 336)
    spike = base.copy()
    spike[200], spike[250], spike[300] = 200, 600, -10
    got = outliers(spark, spike)
    assert got.is_outlier[200] and got.reason[200].startswith("Positive spike")
    assert got.is_outlier[250] and got.reason[250].startswith("Extreme high")
    assert not got.is_outlier[300]
    s = pd.Series(spike)
    z = (s - s.rolling(168, min_periods=24).mean()) / s.rolling(168, min_periods=24).std()
    np.testing.assert_allclose(got.z_score, z, rtol=1e-9)


def test_constant_prices_have_no_score(spark):
    got = outliers(spark, np.full(100, 50.0))
    assert got.z_score.isna().all() and not got.is_outlier.any()


def test_dst_days_complete_by_local_day_only(spark):
    # 2025-03-30 local: 23 hours from 29 Mar 23:00 UTC to 30 Mar 21:00 UTC
    ts = hours(23, dt.datetime(2025, 3, 29, 23))
    df = to_spark(spark, pd.DataFrame({"zone": "A", "ts_utc": ts, "p": 1.0}))
    row = quality.daily_completeness(df).first()
    assert (row.local_date, row.expected, row.actual, row.complete) == (
        dt.date(2025, 3, 30), 23, 23, True,
    )
    assert quality.dst_day_errors(df).count() == 0
    utc_days = quality.daily_completeness(df, "UTC").collect()
    assert {r.complete for r in utc_days} == {False}


def test_autumn_day_has_25_hours(spark):
    ts = hours(25, dt.datetime(2025, 10, 25, 22))
    df = to_spark(spark, pd.DataFrame({"zone": "A", "ts_utc": ts, "p": 1.0}))
    row = quality.daily_completeness(df).first()
    assert (row.expected, row.actual, row.missing) == (25, 25, 0)
    short = df.where(F.hour("ts_utc") != 5)
    bad = quality.dst_day_errors(short).first()
    assert (bad.type, bad.hours, bad.actual) == ("fall_back", 25, 24)


def test_completeness_gate_and_coverage(prices):
    df, _ = prices(100, drop=range(40, 60))
    row = quality.completeness(df).first()
    assert (row.actual_hours, row.expected_hours, row.passes) == (80, 120, False)
    cov = quality.hourly_coverage(df, "price_eur_mwh").first()
    assert (cov.covered_hours, cov.grid_hours, cov.coverage_pct) == (80, 100, 80.0)


def test_rules_report(spark):
    df = spark.createDataFrame(
        [("A", "1.5", None), ("A", "x", None)], "zone string, price_eur_mwh string, note string"
    )
    rows = quality.quality_rules(df, "prices", {"price_eur_mwh": "float", "note": "any", "q": "any"})
    got = {(r.column, r.error): r.n_rows for r in rows.collect()}
    assert got == {("price_eur_mwh", "wrong_type"): 1, ("note", "empty"): 2, ("q", "missing"): 2}
    part = spark.createDataFrame([("A", 1.0)], "zone string, solar_mw double")
    assert quality.quality_rules(part, "wind_solar").count() == 0  # one column is enough


def test_zone_quality_gate(prices, series):
    p, _ = prices(24 * 10, drop=range(24, 96))
    w, _ = series(24, wind_onshore_mw=lambda r, n: r.random(n))
    audit = quality.impute_ffill(w, ["wind_onshore_mw"])[1]
    rows = quality.zone_quality(p, w, w, audit).collect()
    assert all(r.skip and "completeness" in r.errors[0] for r in rows)
    assert quality.passing_zones(p, quality.zone_quality(p, w, w, audit)).count() == 0


def test_listed_zone_without_prices_is_an_error(spark, prices, series):
    p, _ = prices(48)
    w, _ = series(48, wind_onshore_mw=lambda r, n: r.random(n))
    audit = quality.impute_ffill(w, ["wind_onshore_mw"])[1]
    zones = spark.createDataFrame([("A",), ("C",)], "zone string")
    got = {r.zone: r for r in quality.zone_quality(p, w, w, audit, zones=zones).collect()}
    assert got["C"].errors == ["No price data for C"] and got["C"].skip
    assert not got["A"].skip and not got["B"].skip
