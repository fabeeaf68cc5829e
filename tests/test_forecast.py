import numpy as np
import pandas as pd
import pytest
from conftest import hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.functions.time import local_date
from tidegrid.operators import forecast, trading


def scored(spark, actual, predicted):
    pdf = pd.DataFrame(
        {"zone": "A", "ts_utc": hours(len(actual)), "actual_price": np.asarray(actual, float),
         "predicted_price": np.asarray(predicted, float)}
    )
    return to_spark(spark, pdf)


def test_closed_form_metrics(spark):
    row = forecast.evaluate(scored(spark, [10, 20, 0], [12, 16, 0]), "actual_price",
                            "predicted_price").first()
    np.testing.assert_allclose([row.mae, row.rmse], [2.0, np.sqrt(20 / 3)])
    np.testing.assert_allclose(row.smape, 100 * np.mean([2 / 11, 4 / 18]))
    zero = forecast.evaluate(scored(spark, [0, 0], [0, 0]), "actual_price", "predicted_price")
    assert zero.first().smape == 0.0


def test_report_has_overall_and_hourly_rows(spark):
    rng = np.random.default_rng(0)
    df = scored(spark, rng.normal(size=48), rng.normal(size=48))
    rows = forecast.evaluation_report(df, "actual_price", "predicted_price").collect()
    assert sum(r.hour is None for r in rows) == 1 and len(rows) == 25


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(3)
    a, p = rng.integers(0, 6, 96).astype(float), rng.integers(0, 6, 96).astype(float)
    a[72:] = 5.0  # a constant day has no correlation
    row = forecast.rank_correlation(scored(spark, a, p), "actual_price", "predicted_price").first()
    days = [
        pd.Series(a[i:i + 24]).rank().corr(pd.Series(p[i:i + 24]).rank()) for i in (0, 24, 48)
    ]
    np.testing.assert_allclose([row.corr_f, row.n_days], [np.mean(days), 3])
    short = forecast.rank_correlation(scored(spark, a[:11], p[:11]), "actual_price", "predicted_price")
    assert short.first().corr_f is None


def test_split_is_temporal_per_zone(prices):
    df, _ = prices(101)
    got = to_pandas(forecast.temporal_split(df))
    for _, g in got.groupby("zone"):
        assert g.is_train.tolist() == [True] * 70 + [False] * 31


def learn(series, n=24 * 12):
    return series(
        n,
        feature_a=lambda r, n: r.normal(size=n),
        feature_b=lambda r, n: 100 + 30 * r.normal(size=n),
        constant=lambda r, n: np.full(n, 4.0),
        price_eur_mwh=lambda r, n: 40 + r.normal(0, 5, n),
    )


def ridge(train, x, y, l2=1.0):
    """The same learner, fitted with NumPy on the rows themselves."""
    X, Y = train[x].to_numpy(float), train[y].to_numpy(float)
    mean, sd = X.mean(0), X.std(0)
    live = sd > 1e-9
    Z = (X[:, live] - mean[live]) / sd[live]
    beta = np.zeros(len(x))
    beta[live] = np.linalg.solve(Z.T @ Z + l2 * np.eye(live.sum()), Z.T @ (Y - Y.mean())) / sd[live]
    return Y.mean() - beta @ mean, beta


NAMES = ["feature_a", "feature_b", "constant"]


def test_walk_forward_equals_per_fold_fits(spark, series):
    df, pdf = learn(series)
    got = to_pandas(forecast.walk_forward(df, "price_eur_mwh", NAMES, window_days=4))
    pdf["day"] = (pdf.ts_utc + pd.Timedelta(hours=1)).dt.normalize()
    checked = 0
    for zone, g in pdf.groupby("zone"):
        for day in sorted(g.day.unique())[4:]:
            train = g[(g.day < day) & (g.day >= day - pd.Timedelta(days=4))]
            icpt, beta = ridge(train, NAMES, "price_eur_mwh")
            test = g[g.day == day]
            want = icpt + test[NAMES].to_numpy() @ beta
            rows = got[(got.zone == zone) & got.ts_utc.isin(test.ts_utc)]
            np.testing.assert_allclose(rows.predicted_price, want, rtol=1e-8)
            checked += 1
    assert checked == 16 and len(got) == 16 * 24


def test_walk_forward_skips_thin_windows_and_takes_folds(spark, series):
    df, _ = learn(series)
    assert forecast.walk_forward(df, "price_eur_mwh", NAMES, 4, min_rows=97).count() == 0
    dated = df.withColumn("local_date", local_date("ts_utc"))
    days = trading.sample_days(dated, 3, 4)
    got = forecast.walk_forward(df, "price_eur_mwh", NAMES, 4, folds=days)
    assert got.select("zone", "local_date").distinct().count() == 6
    holes = df.withColumn("feature_a", F.when(F.hour("ts_utc") < 12, F.col("feature_a")))
    some = forecast.walk_forward(holes, "price_eur_mwh", NAMES, 4, min_rows=48)
    assert some.where("predicted_price IS NOT NULL").count() == 16 * 12


def test_per_hour_models(spark, series):
    df, pdf = learn(series)
    train = df.where(F.hour("ts_utc") != 3)
    models = forecast.fit_ridge_per_hour(train, "price_eur_mwh", NAMES, day_tz="UTC")
    got = to_pandas(forecast.predict_per_hour(models, df, NAMES, day_tz="UTC"))
    assert (got[got.ts_utc.dt.hour == 3].predicted_price == 0).all()
    one = pdf[(pdf.zone == "B") & (pdf.ts_utc.dt.hour == 7)]
    icpt, beta = ridge(one, NAMES, "price_eur_mwh")
    rows = got[(got.zone == "B") & (got.ts_utc.dt.hour == 7)]
    np.testing.assert_allclose(rows.predicted_price, icpt + one[NAMES].to_numpy() @ beta, rtol=1e-8)


SMALL = {"maxIter": 3, "maxDepth": 3}


def test_boosted_trees_learn_and_rank_features(spark, series):
    df, _ = series(
        200, x=lambda r, n: r.normal(size=n), noise=lambda r, n: r.normal(size=n), price_eur_mwh=0.0
    )
    df = df.withColumn("price_eur_mwh", F.col("x") * 10)
    model = forecast.fit_gbt(df, "price_eur_mwh", ["x", "noise"], SMALL)
    out = forecast.score(model, df, ["x", "noise"])
    assert out.columns == [*df.columns, "predicted_price"]
    row = forecast.evaluate(out, "price_eur_mwh", "predicted_price", by=()).first()
    assert row.mae < 5
    weights = forecast.importance(model, df, ["x", "noise"]).collect()
    assert weights[0].feature == "x" and {r.feature for r in weights} == {"x", "noise", "zone"}


def test_boosted_trees_per_hour(spark, series):
    df, _ = series(24 * 12, zones=("A",), x=lambda r, n: r.normal(size=n))
    df = df.withColumn("price_eur_mwh", F.col("x") * 2).where(F.hour("ts_utc").isin(1, 2))
    models = forecast.fit_gbt_per_hour(df, "price_eur_mwh", ["x"], SMALL, "UTC")
    assert sorted(models) == [1, 2]
    out = forecast.score_per_hour({1: models[1]}, df, ["x"], "UTC")
    assert out.count() == df.count()
    assert out.where("hour(ts_utc) = 2 AND predicted_price <> 0").count() == 0
    assert forecast.importance_per_hour(models, df, ["x"]).count() >= 1


def test_skill_and_winner(spark):
    df = scored(spark, [10.0] * 48, [11.0] * 48).withColumn("baseline", F.lit(12.0))
    row = forecast.skill(df, "actual_price", "predicted_price", "baseline").first()
    assert row.mae_improvement_pct == pytest.approx(50.0)
    rows = forecast.hourly_winner(df, "actual_price", "predicted_price", "baseline").collect()
    assert len(rows) == 24 and {r.winner for r in rows} == {"Single"}


def test_constant_columns_and_missing_features(spark, series):
    names = ["x", "flat", "big"]
    df, pdf = series(24 * 12, x=lambda r, n: r.normal(size=n), flat=3123.37, big=50000.1,
                     price_euro=0.0)
    df = df.withColumn("y", 3 * F.col("x") + 7).drop("price_euro")
    got = to_pandas(forecast.walk_forward(df, "y", names, 4, l2=0.0))
    np.testing.assert_allclose(got.predicted_price, got.actual_price, atol=1e-6)
    models = forecast.fit_ridge_per_hour(df, "y", names, l2=0.0)
    assert models.count() > 0
    flat = models.where("coefficients[2] != 0 OR coefficients[3] != 0")
    assert flat.count() == 0
    holed = df.withColumn("x", F.when(F.hour("ts_utc") != 5, F.col("x")))
    scored = forecast.predict_per_hour(models, holed, names)
    assert scored.where("x IS NULL AND predicted_price IS NOT NULL").count() == 0
    none = forecast.predict_per_hour(models.where("hour < 0"), holed, names)
    assert none.where("predicted_price = 0").count() == none.count()


def test_walk_forward_per_hour_equals_one_hour_at_a_time(spark, series):
    df, _ = series(24 * 16, x=lambda r, n: r.normal(size=n), y=lambda r, n: r.normal(size=n))
    got = to_pandas(forecast.walk_forward(df, "y", ["x"], 12, min_rows=1, day_tz="UTC", per_hour=True))
    at = got.ts_utc.dt.hour
    for hour in (0, 7, 23):
        alone = to_pandas(forecast.walk_forward(
            df.where(F.hour("ts_utc") == hour), "y", ["x"], 12, min_rows=10, day_tz="UTC"))
        both = got[at == hour].merge(alone, on=["zone", "ts_utc"])
        assert len(both) == len(alone) > 0
        np.testing.assert_allclose(both.predicted_price_x, both.predicted_price_y, rtol=1e-9)
    thin = to_pandas(forecast.walk_forward(df, "y", ["x"], 9, min_rows=1, day_tz="UTC", per_hour=True))
    assert (thin.predicted_price == 0).all()  # nine rows an hour are too few


@pytest.mark.parametrize("name", ["g02_boosted_trees", "g05_feature_importance"])
def test_boosted_queries_make_their_matrix_once(spark, series, monkeypatch, name):
    from entries import forecasting

    noise = lambda rng, n: rng.normal(0, 1, n)
    df, pdf = series(60, **{c: noise for c in [forecasting.PRICE, *forecasting.MODEL_FEATURES]})
    made = []
    monkeypatch.setattr(forecasting, "_matrix", lambda *a: made.append(a) or df)
    monkeypatch.setattr(forecasting, "_MODELS", {})
    monkeypatch.setitem(forecast.GBT_PARAMS, "maxIter", 2)
    got = forecasting.QUERIES[name](spark, "somewhere").toPandas()
    assert len(made) == 1
    if name == "g02_boosted_trees":  # the last 30 % of each zone
        assert got.groupby("zone").size().tolist() == [18, 18] and got["predicted_price"].notna().all()
    else:
        assert len(got) == len(forecasting.MODEL_FEATURES) + 1
