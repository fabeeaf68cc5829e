import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import boosting, forecast, trading
from tidegrid.operators.boosting import Settings

SMALL = Settings(trees=12, depth=3, bins=16)
NAMES = ["a", "b", "c"]


def data(n=24 * 40, zones=("A", "B"), seed=3):
    parts = []
    for z, zone in enumerate(zones):
        rng = np.random.default_rng(seed + z)
        x = rng.normal(size=(n, 3))
        y = 3 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, n)
        x[rng.random((n, 3)) < 0.05] = np.nan
        parts.append(pd.DataFrame({"zone": zone, "ts_utc": hours(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "price": y}))
    return pd.concat(parts, ignore_index=True)


def plain_trees(x, y, key, settings):
    """The same learner for one model, node by node with masks."""
    edges = [boosting.bin_edges(x[:, f], settings.bins) for f in range(x.shape[1])]
    pred, trees = np.full(len(y), y.mean()), []
    for t in range(settings.trees):
        seen = boosting.sampled_rows(key, t, settings)
        cols = boosting.sampled_columns(x.shape[1], t, settings)
        grad = pred - y

        def grow(mask, level):
            g = grad[mask & seen]
            if not len(g):
                return 0.0
            total = g.sum() ** 2 / (len(g) + settings.l2)
            options = []
            for f in cols if level < settings.depth else []:
                for thr in [-np.inf, *edges[f]]:
                    low = mask & (np.isnan(x[:, f]) | (x[:, f] <= thr))
                    high = mask & ~low
                    gl, gr = grad[low & seen], grad[high & seen]
                    if len(gl) and len(gr):
                        gain = gl.sum() ** 2 / (len(gl) + settings.l2) + gr.sum() ** 2 / (len(gr) + settings.l2) - total
                        options.append((gain, f, thr, low, high))
            most = max((o[0] for o in options), default=-1)
            if most <= settings.min_gain:
                return -g.sum() / (len(g) + settings.l2) * settings.rate
            _, f, thr, low, high = next(o for o in options if o[0] >= most - boosting.TIE * abs(most))
            return f, thr, grow(low, level + 1), grow(high, level + 1)

        tree = grow(np.ones(len(y), bool), 0)
        trees.append(tree)
        pred = pred + np.array([walk(tree, row) for row in x])
    return lambda rows: y.mean() + np.array([sum(walk(t, r) for t in trees) for r in rows])


def walk(tree, row):
    while isinstance(tree, tuple):
        f, thr, low, high = tree
        tree = high if row[f] > thr else low
    return tree


def hour_key(ts):
    return ((pd.DatetimeIndex(ts) - pd.Timestamp("1970-01-01")) // pd.Timedelta("1h")).to_numpy()


def test_models_grown_together_equal_a_plain_version():
    pdf = data(n=300)
    for settings in (SMALL, Settings(trees=5, depth=6, bins=300, rows=1.0, columns=0.5)):
        x, y = pdf[NAMES].to_numpy(), pdf.price.to_numpy()
        key, model = hour_key(pdf.ts_utc), (pdf.zone == "B").to_numpy().astype(int)
        together = boosting.train(x, y, key, model, 2, settings)
        for k in (0, 1):
            mine = model == k
            want = plain_trees(x[mine], y[mine], key[mine], settings)(x)
            np.testing.assert_allclose(boosting.predict(together[k], x), want, atol=1e-9)


def test_bins_of_few_and_many_values():
    assert boosting.bin_edges(np.array([1.0, 1.0, np.nan]), 8).tolist() == []
    assert boosting.bin_edges(np.array([3.0, 1.0, 2.0, 2.0]), 8).tolist() == [1.5, 2.5]
    edges = boosting.bin_edges(np.arange(1000.0), 11)
    assert len(edges) == 9 and (np.diff(edges) == 100).all()
    assert boosting.codes_of(np.array([np.nan, 0, 1.5, 2, 9]), np.array([1.5, 2.5])).tolist() == [0, 1, 1, 2, 3]


@pytest.fixture(scope="module")
def split(spark):
    rows = to_spark(spark, data(n=400))
    return forecast.temporal_split(rows).cache()


def test_fit_and_score_per_group(spark, split):
    train, test = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    models = boosting.fit_boosted(train, "price", NAMES, settings=SMALL)
    got = to_pandas(boosting.predict_boosted(models, test, NAMES, block_hours=50))
    pdf = train.toPandas()
    for zone, part in got.groupby("zone"):
        mine = pdf[pdf.zone == zone].sort_values("ts_utc")
        fit = plain_trees(mine[NAMES].to_numpy(float), mine.price.to_numpy(), hour_key(mine.ts_utc), SMALL)
        np.testing.assert_allclose(part.predicted_price, fit(part[NAMES].to_numpy(float)), atol=1e-9)
    weights = boosting.importance_table(models, NAMES, ["zone"]).collect()
    assert len(weights) == 6 and abs(sum(r.importance for r in weights) - 2) < 1e-9
    assert weights[0].feature == "a"  # the step is the strongest signal


def test_groups_without_a_model_predict_zero(spark, split):
    train = split.where("is_train").withColumn("hour", F.hour("ts_utc"))
    few = train.where("hour != 5 OR ts_utc < '2025-01-10'")
    models = boosting.fit_boosted(few, "price", NAMES, ("zone", "hour"), SMALL)
    assert models.count() == 2 * 23 and models.agg(F.min("n_rows")).first()[0] >= 10
    test = split.where("NOT is_train").withColumn("hour", F.hour("ts_utc"))
    got = boosting.predict_boosted(models, test, NAMES, ("zone", "hour")).toPandas()
    assert len(got) == 240 and (got[got.hour == 5].predicted_price == 0).all()
    assert (got[got.hour != 5].predicted_price != 0).all()


@pytest.mark.parametrize("per_hour", [False, True])
def test_walk_forward_equals_single_fits(spark, per_hour):
    pdf = data(n=24 * 24, zones=("A",)).drop(index=range(30, 60))
    settings = Settings(trees=4, depth=2, bins=8)
    df = to_spark(spark, pdf)
    folds = spark.createDataFrame(
        [("A", dt.date(2025, 1, d)) for d in (9, 17, 18, 25)] + [("A", dt.date(2025, 1, 7))], "zone string, fold_day date"
    )
    made = to_pandas(boosting.walk_forward_boosted(
        df, "price", NAMES, 12, settings=settings, day_tz="UTC", folds=folds, per_hour=per_hour, block_days=5
    ))
    assert sorted(made.local_date.astype(str).unique()) == ["2025-01-17", "2025-01-18", "2025-01-25"]
    days = pdf.ts_utc.dt.normalize()
    for day, part in made.groupby("local_date"):
        day = pd.Timestamp(day)
        past = pdf[(days < day) & (days >= day - pd.Timedelta(days=12))]
        now = pdf[days == day]
        want = np.zeros(len(now))
        for h in range(24) if per_hour else [None]:
            p = past if h is None else past[past.ts_utc.dt.hour == h]
            t = np.ones(len(now), bool) if h is None else (now.ts_utc.dt.hour == h).to_numpy()
            if len(p) >= 10 and t.any():
                fit = plain_trees(p[NAMES].to_numpy(), p.price.to_numpy(), hour_key(p.ts_utc), settings)
                want[t] = fit(now[NAMES].to_numpy()[t])
        np.testing.assert_allclose(part.predicted_price, want, atol=1e-9)
        np.testing.assert_allclose(part.actual_price, now.price)


def test_every_day_after_the_window_is_a_fold(spark):
    df = to_spark(spark, data(n=24 * 20))
    made = boosting.walk_forward_boosted(
        df, "price", NAMES, 10, settings=Settings(trees=2, depth=2), day_tz="UTC", block_days=7
    )
    days = trading.fold_days(df.withColumn("d", F.to_date("ts_utc")), "d", 10)
    assert made.select("zone", "local_date").distinct().count() == days.count()


def test_permutation_importance_of_fixed_coefficients(spark):
    pdf = data(n=24 * 40).fillna(0.0)
    df = to_spark(spark, pdf)
    score = lambda rows: rows.withColumn("predicted_price", F.col("a") * 2 + F.col("b") * 0.5)
    got = boosting.permutation_importance(df, score, "price", NAMES, chunk_hours=200, seed=7)
    got = {(r.zone, r.feature): r.importance for r in got.collect()}
    hashes = {
        (r.ts_utc, c): h for r in df.where("zone = 'A'").select(
            "ts_utc", *[F.xxhash64("ts_utc", F.lit(c), F.lit(7)).alias(f"h_{c}") for c in NAMES]
        ).collect() for c, h in zip(NAMES, r[1:])
    }
    for zone, part in pdf.groupby("zone"):
        part = part.assign(chunk=hour_key(part.ts_utc) // 200)
        root = lambda p: np.sqrt(np.mean((p.price - 2 * p.a - 0.5 * p.b) ** 2))
        for c in NAMES:
            moved = []
            for _, g in part.groupby("chunk"):
                order = sorted(range(len(g)), key=lambda k: hashes[g.ts_utc.iloc[k], c])
                moved.append(g.assign(**{c: g[c].to_numpy()[order]}))
            np.testing.assert_allclose(got[zone, c], root(pd.concat(moved)) - root(part), atol=1e-9)
    assert got["A", "c"] == 0 and got["A", "a"] > got["A", "b"] > 0
