import datetime as dt
import json

import numpy as np
import pytest
from conftest import START, hours
from pyspark.sql import functions as F

from tidegrid.operators import features
from tidegrid.operators.boosting import Settings
from tidegrid.plans import daily_run, ingest, sampled_backtest, zone_ranking
from tidegrid.session import staged
from tidegrid.sources import store
from tidegrid.streaming import landing


@pytest.fixture
def market_tables(series):
    day = lambda n: np.sin(2 * np.pi * np.arange(n) / 24)
    n = 24 * 16
    p, _ = series(n, price_eur_mwh=lambda r, n: 40 + 20 * day(n) + r.normal(0, 3, n))
    w, _ = series(
        n, wind_onshore_mw=lambda r, n: r.uniform(0, 90, n), wind_offshore_mw=lambda r, n: r.uniform(0, 50, n),
        solar_mw=lambda r, n: 30 * np.clip(day(n), 0, 1),
    )
    load, _ = series(n, load_mw=lambda r, n: 3000 + 500 * day(n) + r.normal(0, 50, n))
    seq = lambda df: df.withColumn("ingest_no", F.lit(1))
    return {
        "prices": (seq(p), ["price_eur_mwh"]),
        "wind_solar": (seq(w), ["wind_onshore_mw", "wind_offshore_mw", "solar_mw"]),
        "load": (seq(load), ["load_mw"]),
    }


def test_daily_run_writes_every_report(spark, market_tables, tmp_path):
    out = str(tmp_path)
    summary = daily_run.run(
        market_tables, out, "2025-02-01 12:00:00", window_days=4, params={"maxIter": 2, "maxDepth": 2}
    ).collect()
    assert {r.zone for r in summary} == {"A", "B"}
    assert all(r.total_pnl > 0 and r.n_trading_days >= 4 for r in summary)  # a clear daily pattern
    metrics = {r.zone: r for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert metrics["A"].mae > 0 and metrics["A"].corr_f > 0.5
    drift = spark.read.json(f"{out}/drift").collect()
    assert all("not enough history" in r.message for r in drift)
    assert spark.read.parquet(f"{out}/error_history").count() == 2
    for name in ("imputation_audit", "quality", "importance", "results", "summary"):
        assert (tmp_path / name / "_SUCCESS").exists()


def test_sampled_backtest_fills_only_new_days(spark, market_tables, tmp_path):
    matrix = staged(daily_run.prepare(market_tables)["matrix"], "matrix")
    names = features.feature_names(matrix)
    path = str(tmp_path / "results")
    first = sampled_backtest.run(matrix, names, path, n_samples=2, window_days=4).collect()
    assert {r.n_test_days for r in first} == {2}
    marked = spark.read.parquet(path).withColumn("pnl", F.lit(1000.0))
    marked.write.parquet(str(tmp_path / "marked"))
    again = sampled_backtest.run(
        matrix, names, str(tmp_path / "marked"), n_samples=4, window_days=4
    ).collect()
    assert {r.n_test_days for r in again} == {4}
    kept = spark.read.parquet(str(tmp_path / "marked")).where("pnl = 1000")
    assert kept.count() == 2 * 2 * 24  # stored days were not scored again
    assert {(r.status, r.n_sampled, r.n_cached, r.n_new) for r in again} == {("ok", 4, 2, 2)}


def test_sampled_backtest_states_what_is_missing(spark, market_tables, tmp_path):
    matrix = staged(daily_run.prepare(market_tables)["matrix"], "matrix")
    short = matrix.where("zone = 'A' OR ts_utc < '2025-01-16'")
    zones = spark.createDataFrame([("A",), ("B",), ("C",)], "zone string")
    got = sampled_backtest.run(
        staged(short, "short"), features.feature_names(matrix), str(tmp_path / "results"), n_samples=2,
        window_days=4, zones=zones, learner="boosted", settings=Settings(trees=3, depth=2),
    ).collect()
    assert {r.zone: (r.status, r.n_sampled, r.n_new, r.n_test_days) for r in got} == {
        "A": ("ok", 2, 2, 2), "B": ("no_results", 0, 0, 0), "C": ("no_data", 0, 0, 0),
    }


def test_price_only_zones_get_their_own_model(spark, market_tables, tmp_path):
    lone = {
        name: (df if name == "prices" else df.where("zone = 'A'"), cols)
        for name, (df, cols) in market_tables.items()
    }
    summary = daily_run.run(
        lone, str(tmp_path), "2025-02-01 12:00:00", window_days=4, params={"maxIter": 1, "maxDepth": 1}
    )
    assert {r.zone: r.n_trading_days for r in summary.collect()} == {"A": 5, "B": 5}


def test_rankings(spark, prices):
    df, _ = prices(60)
    zones = spark.createDataFrame(
        [("A", "Zone A", 1.0, 10.0), ("B", "Zone B", 2.0, 20.0)],
        "zone string, label string, entry_cost_eur double, annual_cost double",
    )
    report = zone_ranking.attractiveness_report(df, zones, None, None)
    assert sorted(r.rank for r in report.collect()) == [1, 2]
    summary = spark.createDataFrame(
        [("A", 1.0, 5), ("B", 9.0, 5)], "zone string, total_pnl double, n_trading_days long"
    )
    best = zone_ranking.earnings_report(summary, zones).where("rank = 1").first()
    assert best.zone == "B"


def test_ingest_payloads_and_exports(spark, tmp_path):
    def document(field, values):
        return json.dumps({"records": [
            {"HourUTC": t.isoformat(), "PriceArea": "DK1", field: v} for t, v in zip(hours(24), values)
        ]})

    for name in ("spot", "production", "csv"):
        (tmp_path / name).mkdir()
    (tmp_path / "spot" / "a.json").write_text(document("SpotPriceEUR", range(24)))
    (tmp_path / "production" / "a.json").write_text(document("TotalLoad", range(100, 124)))
    (tmp_path / "csv" / "prices_DK2.csv").write_text("DateTime,Price\n2025-01-01 00:00,5\n")
    root = str(tmp_path / "root")
    ingest.ingest_payloads(spark, str(tmp_path / "spot"), str(tmp_path / "production"), root)
    ingest.ingest_exports(spark, str(tmp_path / "csv"), "UTC", root)
    prices = store.read_series(spark, root, "day_ahead_prices")
    assert {(r.source, r.zone): r["count"] for r in prices.groupBy("source", "zone").count().collect()} == {
        ("energinet", "DK_1"): 24, ("entsoe", "DK_2"): 1,
    }
    load = store.read_series(spark, root, "load_forecast")
    assert load.agg(F.min("load_mw"), F.count("load_mw")).first()[:] == (100.0, 24)


def test_stream_merges_late_rows(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "root")
    schema = "source string, zone string, ts_utc timestamp_ntz, load_mw double, seq int"
    first = [("s", "A", t, 1.0, 1) for t in hours(24)]
    late = [("s", "A", t, 2.0, 2) for t in hours(6)] + [("s", "A", t, 3.0, 3) for t in hours(3)]
    for batch in (first, late):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(landed))
        rows = landing.landed_rows(spark, str(landed), schema)
        query = landing.merge_stream(rows, root, "load_forecast", "seq", str(tmp_path / "cp"))
        query.awaitTermination(120)
    df = store.read_series(spark, root, "load_forecast")
    assert df.count() == 24 and df.agg(F.sum("load_mw")).first()[0] == 18 + 3 * 2 + 3 * 3


def test_stream_hourly_means(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    rows = [("A", base + dt.timedelta(minutes=20 * i), float(i)) for i in range(60)]
    schema = "zone string, ts timestamp, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    means = landing.hourly_means(landing.landed_rows(spark, str(tmp_path / "in"), schema), "v")
    query = means.writeStream.format("memory").queryName("means").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.ts: r.v for r in spark.table("means").collect()}
    assert got[base] == 1.0 and len(got) < 20  # hours behind the watermark only
