import numpy as np
import pandas as pd
from conftest import hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import profiles, screen


def test_profiles_and_box(prices):
    df, pdf = prices(24 * 10)
    local = (pdf.ts_utc + pd.Timedelta(hours=1)).dt
    got = to_pandas(profiles.profile_by(df, "hour"), "zone", "hour")
    want = pdf.groupby(["zone", local.hour]).price_eur_mwh.mean()
    np.testing.assert_allclose(got.mean_price_eur_mwh, want)
    box = to_pandas(profiles.box_stats(df), "zone", "hour")
    q = pdf.groupby(["zone", local.hour]).price_eur_mwh.quantile
    np.testing.assert_allclose(box.q1, q(0.25))
    np.testing.assert_allclose(box["median"], q(0.5))
    assert (box.whisker_lo <= box.q1).all() and (box.whisker_hi >= box.q3).all()


def test_describe_matches_pandas(prices):
    df, pdf = prices(301)
    got = to_pandas(profiles.describe(df, "price_eur_mwh"), "zone").set_index("zone")
    want = pdf.groupby("zone").price_eur_mwh.describe()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))


def test_constant_column_has_no_correlation(series):
    df, pdf = series(50, x=lambda r, n: r.normal(size=n), y=lambda r, n: r.normal(size=n), c=1.0)
    rows = profiles.correlation_matrix(df, ["x", "y", "c"]).where("zone = 'A'").collect()
    got = {(r.column_a, r.column_b): r.r for r in rows}
    a = pdf[pdf.zone == "A"]
    np.testing.assert_allclose(got["x", "y"], a.x.corr(a.y))
    assert got["x", "c"] is None and got["c", "c"] is None and len(got) == 9
    pairs = {r.column: r.r for r in profiles.correlation_with(df, "x", ["y", "c"]).collect()}
    assert pairs["c"] is None


def test_autocorrelation(prices):
    df, pdf = prices(200, zones=("A",))
    got = to_pandas(profiles.autocorrelation(df, max_lag=30), "lag_hours")
    want = [pdf.price_eur_mwh.autocorr(k) for k in range(1, 31)]
    np.testing.assert_allclose(got.r, want, rtol=1e-9)


def edges(spark):
    return spark.createDataFrame([("A", "B", 10)], "from_zone string, to_zone string, capacity_mw int")


def test_cross_zone(spark, prices):
    df, pdf = prices(200)
    wide = pdf.pivot(index="ts_utc", columns="zone", values="price_eur_mwh")
    got = {(r.zone, r.neighbour): r for r in
           profiles.lagged_cross_correlation(edges(spark), df).collect()}
    np.testing.assert_allclose(got["A", "B"].lag_2h, wide.A.corr(wide.B.shift(2)))
    np.testing.assert_allclose(got["B", "A"].lag_3h, wide.B.corr(wide.A.shift(3)))
    row = profiles.adjacent_correlation(edges(spark), df).first()
    np.testing.assert_allclose([row.correlation, row.n_hours], [wide.A.corr(wide.B), 200])
    spread = wide.A - wide.B
    s = profiles.spread_stats(edges(spark), df).first()
    np.testing.assert_allclose([s.mean_spread, s.std_spread], [spread.mean(), spread.std()])
    assert profiles.adjacent_correlation(edges(spark), df.limit(50)).count() == 0


def test_bins_follow_cut(series):
    df, pdf = series(500, zones=("A",), x=lambda r, n: r.gamma(2, 50, n), y=lambda r, n: r.normal(size=n))
    got = to_pandas(profiles.binned_curve(df, "x", "y"), "bin").set_index("bin")
    codes = pd.cut(pdf.x, 20, labels=False) + 1
    want = pdf.y.groupby(codes).agg(["mean", "median", "std", "count"])
    np.testing.assert_allclose(got[["mean", "median", "std", "n"]], want)


def test_histogram_follows_numpy(series):
    df, pdf = series(400, zones=("A",), x=lambda r, n: r.normal(size=n))
    got = to_pandas(profiles.histogram(df, "x", 10), "bin")
    want, _ = np.histogram(pdf.x, 10)
    assert dict(zip(got.bin, got.n)) == {i + 1: n for i, n in enumerate(want) if n}


def test_clip_and_tails(prices):
    df, pdf = prices(500, zones=("A",))
    p = pdf.price_eur_mwh
    clipped = to_pandas(screen.clip_to_quantiles(df, "price_eur_mwh")).clipped
    np.testing.assert_allclose(clipped, p.clip(p.quantile(0.001), p.quantile(0.999)))
    got = {r.segment: r.n_hours for r in profiles.tail_conditions(df, []).collect()}
    lo, hi = p.quantile(0.01), p.quantile(0.99)
    assert got == {"bottom": (p <= lo).sum(), "top": (p >= hi).sum(),
                   "middle": ((p > lo) & (p < hi)).sum()}


def test_extremes_break_ties_by_time(spark):
    pdf = pd.DataFrame({"zone": "A", "ts_utc": hours(30), "price_eur_mwh": [1.0] * 15 + [2.0] * 15})
    got = profiles.extreme_hours(to_spark(spark, pdf), 3).orderBy("rank").collect()
    assert [r.ts_utc for r in got] == hours(30)[15:18]
    plan = profiles.extreme_hours(to_spark(spark, pdf), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # the rank filter runs before the shuffle


def test_ranking_of_equal_zones(spark, prices):
    zones = spark.createDataFrame(
        [("A", "Zone A", 10.0), ("B", "Zone B", 10.0)],
        "zone string, label string, entry_cost_eur double",
    )
    df, _ = prices(50)
    scored = profiles.attractiveness(profiles.zone_metrics(df, zones, None, df))
    rows = {r.zone: r for r in profiles.ranked(scored, "attractiveness").collect()}
    assert {r.entry_cost_eur_norm for r in rows.values()} == {0.5}  # constant metric
    assert {r.data_score for r in rows.values()} == {0.5}
    assert sorted(r.rank for r in rows.values()) == [1, 2]


def test_null_share_and_week_means(spark):
    pdf = pd.DataFrame({"zone": "A", "ts_utc": hours(4), "x": [1.0, np.nan, np.nan, 4.0]})
    df = to_spark(spark, pdf)
    assert profiles.null_share(df, ["x"]).first().null_pct == 50.0
    assert str(profiles.resample_mean(df, "week", "x").first().period) == "2025-01-12"


def test_one_extreme_value_leaves_bins_even(spark):
    from tidegrid.operators.quantiles import BINS, exact_quantiles

    values = [float(v) for v in np.random.default_rng(0).uniform(0, 100, 20_000)] + [1e9]
    df = spark.createDataFrame([("A", v) for v in values], "zone string, v double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, "v", [0.1, 0.5, 0.999]).collect()}
    for p, q in got.items():
        np.testing.assert_allclose(q, np.quantile(values, p), rtol=1e-12)
    cuts = df.selectExpr(
        f"percentile_approx(v, array({', '.join(str(i / BINS) + 'D' for i in range(1, BINS))}), {20 * BINS}) AS c")
    held = df.crossJoin(cuts).groupBy(F.expr("size(filter(c, x -> x <= v))")).count()
    assert held.agg(F.max("count")).first()[0] < 0.03 * len(values)


def test_ranks_over_ranges_equal_one_window(spark):
    from pyspark.sql import Window

    rows = [(f"z{k:03}", None if k % 17 == 0 else float(k * 7919 % 40)) for k in range(300)]
    df = spark.createDataFrame(rows, "zone string, score double")
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "zone")))
    got = profiles.ranked(df, "score", ranges=7)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert profiles.ranked(df.where("false"), "score").count() == 0
