import datetime as dt

import numpy as np
import pandas as pd
from conftest import START, hours, to_pandas, to_spark
from pyspark.sql import functions as F

from tidegrid.operators import align
from tidegrid.sources import store


def test_dedup_first_and_last(spark):
    pdf = pd.DataFrame(
        {"zone": "A", "ts_utc": [START] * 3, "v": [1.0, np.nan, 3.0], "seq": [2, 1, 3]}
    )
    df = to_spark(spark, pdf)
    assert align.dedup(df, "seq").first().v is None  # first row, though NULL
    assert align.dedup(df, "seq", "last").first().v == 3.0


def test_grid_of_mixed_hourly_and_quarter_hourly_rows(spark):
    quarter = [START + dt.timedelta(minutes=15 * i) for i in range(8)]
    later = [START + dt.timedelta(hours=5)]
    pdf = pd.DataFrame({"zone": "A", "ts_utc": quarter + later, "v": [*range(8), 100]}).astype(
        {"v": float}
    )
    df = to_spark(spark, pdf)
    mean = to_pandas(align.to_grid(df, ["v"]))
    assert mean.ts_utc.tolist() == hours(6)
    assert mean.v.tolist()[:2] == [1.5, 5.5] and mean.v.isna().sum() == 3
    first = to_pandas(align.to_grid(df, ["v"], agg="first"))
    assert first.v.tolist()[:2] == [0.0, 4.0]


def test_gaps(prices):
    df, _ = prices(48, drop=[5, 6, 30])
    got = to_pandas(align.gaps(df))
    assert got[got.zone == "A"].ts_utc.tolist() == [hours(48)[i] for i in (5, 6, 30)]
    whole, _ = prices(48)
    assert align.gaps(whole).count() == 0


def sources(spark):
    rows = [
        ("energinet", "A", 0, 1.0), ("energinet", "A", 1, None),
        ("entsoe", "A", 1, 2.0), ("entsoe", "A", 2, 3.0), ("entsoe", "B", 0, 9.0),
    ]
    return spark.createDataFrame(
        [(s, z, START + dt.timedelta(hours=h), v) for s, z, h, v in rows],
        "source string, zone string, ts_utc timestamp_ntz, v double",
    )


def test_reconcile_fills_nulls_but_adds_no_hours(spark):
    filled, report = align.reconcile(sources(spark), "v", ["energinet", "entsoe"])
    got = [(r.zone, r.v, r.provenance) for r in filled.orderBy("zone", "ts_utc").collect()]
    assert got == [("A", 1.0, "energinet"), ("A", 2.0, "entsoe"), ("B", 9.0, "entsoe")]
    counts = {(r.zone, r.primary_source, r.provenance): r.hours for r in report.collect()}
    assert counts["B", "entsoe", "entsoe"] == 1 and counts["A", "energinet", "entsoe"] == 1


def test_reconcile_extended_keeps_the_union(spark):
    filled, _ = align.reconcile(sources(spark), "v", ["energinet", "entsoe"], extend=True)
    assert filled.where("zone = 'A'").count() == 3


def test_source_choice(spark):
    zones = spark.createDataFrame([("A",), ("B",), ("C",)], "zone string")
    got = {r.zone: r.source for r in
           align.zone_sources(sources(spark), zones, ["energinet", "entsoe"]).collect()}
    assert got == {"A": "energinet", "B": "entsoe", "C": "none"}
    picked = align.pick_source(sources(spark), ["energinet", "entsoe"])
    assert {(r.zone, r.source) for r in picked.collect()} == {("A", "energinet"), ("B", "entsoe")}


def test_compare_sources(spark):
    got = align.compare_sources(sources(spark), "v", ["energinet", "entsoe"])
    assert got.columns == ["zone", "ts_utc", "energinet", "entsoe", "diff_energinet_entsoe"]
    assert got.count() == 4


def test_merge_overlap_gives_36_rows(prices):
    a, _ = prices(24, zones=("A",))
    b, _ = prices(24, zones=("A",), start=START + dt.timedelta(hours=12), seed=7)
    merged = store.merge_series(a, b, ["zone", "ts_utc"])
    assert merged.count() == 36
    overlap = merged.join(b.withColumnRenamed("price_eur_mwh", "new"), ["zone", "ts_utc"])
    assert overlap.where("price_eur_mwh <> new").count() == 0


def test_training_rows_and_folds(prices):
    df, pdf = prices(24 * 6, zones=("A",))
    df = df.withColumn("d", F.col("ts_utc").cast("date"))
    folds = sorted(r.fold_day for r in align.fold_days(df, "d", 3).collect())
    first = START.date()
    assert folds[0] == first + dt.timedelta(days=3)
    rows = align.training_rows(df, "d", 3).groupBy("fold_day").count().collect()
    assert {r["count"] for r in rows if r.fold_day == first + dt.timedelta(days=4)} == {72}


def test_price_matrix_drops_all_null_hours(spark):
    pdf = pd.DataFrame(
        {"zone": ["A", "B", "A"], "ts_utc": [*hours(1) * 2, hours(2)[1]], "p": [1.0, 2.0, np.nan]}
    )
    m = align.price_matrix(to_spark(spark, pdf), "p", ["A", "B"])
    assert [tuple(r)[1:] for r in m.collect()] == [(1.0, 2.0)]


def test_first_of_repeated_rows_counts(spark):
    rows = [("a", "A", START, 10.0, 1), ("a", "A", START, 90.0, 2), ("b", "A", START, 5.0, 2),
            ("b", "A", START, 4.0, 1), ("a", "B", START, None, 1), ("a", "B", START, 7.0, 2)]
    df = spark.createDataFrame(rows, "source string, zone string, ts_utc timestamp_ntz, v double, seq int")
    wide = {r.zone: r for r in align.compare_sources(df, "v", ["a", "b"], order="seq").collect()}
    assert (wide["A"].a, wide["A"].b, wide["A"].diff_a_b) == (10.0, 4.0, 6.0) and wide["B"].a is None
    filled, _ = align.reconcile(df.coalesce(1), "v", ["a", "b"])  # as read
    assert {r.zone: r.v for r in filled.collect()} == {"A": 10.0, "B": None}
    matrix = align.price_matrix(df.where("source = 'a'"), "v", ["A", "B"], order="seq").first()
    assert (matrix.A, matrix.B) == (10.0, None)


def test_gap_intervals_cost_one_row_each(spark):
    at = [*hours(3), *hours(2, START + dt.timedelta(hours=10)), *hours(5, START + dt.timedelta(days=3650))]
    rows = [(z, t) for z in "AB" for t in at] + [("C", START)] + [("A", START)]
    df = spark.createDataFrame(rows, "zone string, ts_utc timestamp_ntz")
    got = sorted((r.zone, r.n_hours) for r in align.gap_intervals(df).collect())
    assert got == [(z, n) for z in "AB" for n in (7, 3650 * 24 - 12)]
    short = df.where("ts_utc < '2026-01-01'")
    missing = {(r.zone, r.ts_utc) for r in align.gaps(short, ).collect()}
    assert missing == {(z, START + dt.timedelta(hours=h)) for z in "AB" for h in range(3, 10)}
