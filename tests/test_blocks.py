import re

import numpy as np
import pandas as pd
import pytest
from conftest import hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import align, blocks, features, forecast, profiles, quality, screen
from tidegrid.operators.blocks import hours_back, running, trailing, trailing_rows, with_position
from tidegrid.operators.quantiles import exact_quantiles, quantile_columns


def test_blocked_window_equals_flat_window(prices):
    df, pdf = prices(500)
    got = to_pandas(
        trailing(
            df,
            191,
            lambda w: {"m": F.avg("price_eur_mwh").over(w.rangeBetween(-191, -24))},
            block=200,
        )
    )
    want = pdf.groupby("zone").price_eur_mwh.transform(
        lambda s: s.shift(24).rolling(168, min_periods=1).mean()
    )
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got.m, want, rtol=1e-12)


def test_block_shorter_than_frame_is_refused(prices):
    df, _ = prices(24)
    with pytest.raises(ValueError):
        trailing(df, 100, lambda w: {}, block=50)


def test_positions_are_gapless_over_chunks_and_gaps(prices):
    df, pdf = prices(400, drop=list(range(50, 170)) + [300])
    got = to_pandas(with_position(df, chunk_hours=24))
    for _, g in got.groupby("zone"):
        assert g.pos.tolist() == list(range(len(g)))


def test_row_frames_count_rows_across_gaps(prices):
    df, pdf = prices(300, drop=range(60, 140))
    got = to_pandas(
        trailing_rows(
            df, 5, lambda w: {"s": F.sum("price_eur_mwh").over(w.rowsBetween(-5, 0))}, block=7
        )
    )
    want = pdf.groupby("zone").price_eur_mwh.transform(lambda s: s.rolling(6, min_periods=1).sum())
    np.testing.assert_allclose(got.s, want)


def test_hours_back_skips_missing_hours(prices):
    df, pdf = prices(60, drop=[10])
    got = to_pandas(trailing(df, 24, lambda w: {"l": hours_back("price_eur_mwh", 24, w)}))
    one = got[got.zone == "A"].set_index("ts_utc").l
    full = pdf[pdf.zone == "A"].set_index("ts_utc").price_eur_mwh
    assert np.isnan(one.iloc[33])  # 24 h after the dropped hour
    assert one.iloc[40] == full.iloc[40 - 24]


def test_running_total_and_peak_over_days(series):
    df, pdf = series(24 * 9, pnl=lambda rng, n: rng.normal(0, 1, n) - 0.2)
    df = df.withColumn("local_date", F.col("ts_utc").cast("date"))
    got = to_pandas(running(df, "pnl", ["zone"], "local_date"))
    cum = pdf.groupby("zone").pnl.cumsum()
    np.testing.assert_allclose(got.cumulative, cum, atol=1e-12)
    np.testing.assert_allclose(got.peak, cum.groupby(pdf.zone).cummax(), atol=1e-12)


def test_quantiles_exact_on_skewed_and_tied_values(spark):
    rng = np.random.default_rng(1)
    parts = [
        pd.DataFrame({"zone": "tail", "v": np.exp(rng.normal(0, 4, 3001))}),
        pd.DataFrame({"zone": "ties", "v": rng.integers(0, 3, 1000).astype(float)}),
        pd.DataFrame({"zone": "same", "v": np.full(10, 7.0)}),
        pd.DataFrame({"zone": "one", "v": [3.5]}),
        pd.DataFrame({"zone": "nulls", "v": [1.0, np.nan, 2.0]}),
    ]
    pdf = pd.concat(parts, ignore_index=True)
    probs = [0, 0.001, 0.25, 0.5, 0.9, 0.999, 1]
    got = exact_quantiles(to_spark(spark, pdf), "v", probs).toPandas()
    for zone, g in got.groupby("zone"):
        want = pdf[pdf.zone == zone].v.dropna().quantile(probs)
        np.testing.assert_allclose(g.sort_values("prob_no")["quantile"], want, rtol=1e-12)
    assert len(got) == 5 * len(probs)


def test_quantiles_without_groups(spark):
    pdf = pd.DataFrame({"v": np.arange(11.0)})
    row = quantile_columns(to_spark(spark, pdf), "v", {"q": 0.25}, by=()).first()
    assert row.q == 2.5


def wide(spark):
    rows = [("A" if k % 3 else "B", "s" if k % 2 else "t", t, float(k % 17), float(k)) for k, t in enumerate(hours(300))]
    return spark.createDataFrame(rows, "zone string, source string, ts_utc timestamp_ntz, price_eur_mwh double, x double")


def test_attach_joins_like_a_plain_join(spark):
    df = wide(spark).withColumn("zone", F.when(F.col("x") == 7, None).otherwise(F.col("zone")))
    values = spark.createDataFrame([("A", 1.0), ("C", 2.0)], "zone string, v double")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = blocks.attach(df, values, how=how, parts=5)
        want = df.join(values, "zone", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how
    with pytest.raises(ValueError):
        blocks.attach(df, values, how="full")


def test_rows_are_not_sent_by_zone_alone(spark):
    """With broadcasts off, no sort-merge join of hourly rows has the zone as its only key."""
    df = wide(spark)
    bad = spark.createDataFrame([("A", True)], "zone string, skip boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, made in {
            "clip": screen.clip_to_quantiles(df, "price_eur_mwh"),
            "pick": align.pick_source(df, ["s", "t"]),
            "passing": quality.passing_zones(df, bad),
            "complete": features.model_rows(df),
            "curve": profiles.binned_curve(df, "x", "price_eur_mwh"),
            "histogram": profiles.histogram(df, "price_eur_mwh"),
            "tails": profiles.with_tail_segment(df),
            "split": forecast.temporal_split(df.where("source = 's'")),
            "reconcile": align.reconcile(df, "price_eur_mwh", ["s", "t"], order="x")[0],
        }.items():
            plan = made._jdf.queryExecution().executedPlan().toString()
            keys = re.findall(r"SortMergeJoin(?:\(skew=true\))? \[([^\]]*)\]", plan)
            assert keys, name
            assert any("_part" in k for k in keys), name
            rows_by_zone = [k for k in keys if re.fullmatch(r"zone#\d+", k)]
            # only tables of one row per zone, or per zone and quantile, may meet by zone
            assert len(rows_by_zone) == 0, (name, keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("block", [200, 2160])
def test_moments_of_frames_equal_windows(spark, block):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"zone": "A", "ts_utc": hours(900), "v": rng.normal(50, 3, 900)})
    pdf.loc[100:300, "v"] = 50.125  # constant windows
    pdf.loc[400:430, "v"] = np.nan
    pdf.loc[500:, "v"] = rng.normal(-30, 90, 400)
    df = to_spark(spark, pdf.drop(index=range(600, 640)))

    def build(w):
        n, mean, std = blocks.frame_moments("v", -190, -24)
        frame = w.rangeBetween(-190, -24)
        v = F.col("v")
        return {
            "n": n, "mean": mean, "std": std, "n0": F.count(v).over(frame), "mean0": F.avg(v).over(frame),
            "std0": F.stddev_samp(v).over(frame),
        }

    got = to_pandas(trailing(df, 191, build, block=block, moments=[("v", -190, -24)]))
    assert (got.n == got.n0).all() and (got.std0 == 0).sum() > 30
    for name in ("mean", "std"):
        np.testing.assert_allclose(got[name].astype(float), got[f"{name}0"].astype(float), rtol=1e-9, atol=1e-9)
