import datetime as dt
import json

import pytest
from conftest import START, hours
from pyspark.sql import functions as F

from tidegrid.sources import dims, exports, records, schemas, store

PRICE_COLUMNS = "source string, zone string, ts_utc timestamp_ntz, price_eur_mwh double, price_dkk_mwh double"


def stored(spark, rows):
    return spark.createDataFrame(
        [(s, z, t, float(v), None) for s, z, t, v in rows], PRICE_COLUMNS
    )


def test_absent_table_reads_empty(spark, tmp_path):
    df = store.read_series(spark, str(tmp_path / "none"), "load_forecast")
    assert df.count() == 0 and "load_mw" in df.columns
    assert store.coverage(df).count() == 0


def test_round_trip_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "a")
    rows = [("s1", z, t, i) for z in "AB" for i, t in enumerate(hours(48))]
    store.write_series(stored(spark, rows), root, "day_ahead_prices")
    df = store.read_series(spark, root, "day_ahead_prices", "s1", ["A"], "2025-01-06 00:00:00")
    assert df.count() == 47 and {r.zone for r in df.collect()} == {"A"}
    plan = df._jdf.queryExecution().toString()
    assert "(source#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1]
    assert "EqualTo(zone,A)" in pushed and "GreaterThanOrEqual(ts_utc" in pushed


def test_overwrite_touches_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "b")
    store.write_series(stored(spark, [("s", "A", START, 1), ("s", "B", START, 2)]), root, "day_ahead_prices")
    store.write_series(stored(spark, [("s", "A", START, 9)]), root, "day_ahead_prices")
    got = {r.zone: r.price_eur_mwh for r in store.read_series(spark, root, "day_ahead_prices").collect()}
    assert got == {"A": 9.0, "B": 2.0}


def test_merge_into_overlap(spark, tmp_path):
    root = str(tmp_path / "c")
    first = [("s", "A", t, 0) for t in hours(24)]
    second = [("s", "A", t, 1) for t in hours(24, START + dt.timedelta(hours=12))]
    for batch in (first, second, second):  # a repeated batch changes nothing
        store.merge_into(stored(spark, batch), root, "day_ahead_prices")
    df = store.read_series(spark, root, "day_ahead_prices")
    assert df.count() == 36 and df.agg(F.sum("price_eur_mwh")).first()[0] == 24


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "a")], "v double, z string")
    assert schemas.nan_to_null(df).first().v is None


def test_coverage_and_chunks(spark):
    df = stored(spark, [("s", "A", dt.datetime(2024, 1, 1), 1), ("s", "A", dt.datetime(2024, 7, 1), 1)])
    assert store.covers(df, "2024-01-01 00:00:00", "2024-07-01 01:00:00").first().covered
    assert not store.covers(df, "2023-12-31 23:00:00", "2024-07-01 01:00:00").first().covered
    months = store.missing_chunks(df, "2024-01-01", "2024-12-31", "3 months").orderBy("chunk_start")
    assert [(r.chunk_start.month, str(r.chunk_end)) for r in months.collect()] == [
        (4, "2024-07-01"), (10, "2024-12-31"),
    ]
    years = store.missing_chunks(df, "2023-01-01", "2025-01-01", "365 days").collect()
    assert {str(r.chunk_start) for r in years} == {"2023-01-01", "2024-12-31"}


def test_reports_and_summary(spark, tmp_path):
    rows = [
        {"zone": "A", "status": "ok", "total_pnl": 1.5, "sharpe_ratio": 2.0, "win_rate_pct": 50.0,
         "n_trades": 8, "n_test_days": 1, "extra": 0},
        {"zone": "B", "status": "no_data"},
    ]
    path = tmp_path / "summary.json"
    path.write_text(json.dumps(rows, indent=2))
    got = store.read_summary(spark, str(path)).collect()
    assert [(r.zone, r.backtest_pnl, r.trades) for r in got] == [("A", 1.5, 8)]
    with pytest.raises(ValueError):
        store.write_report(spark.range(1), str(tmp_path / "x"), "xml")


def test_spot_payload_files(spark, tmp_path):
    document = {"total": 2, "records": [
        {"HourUTC": "2025-01-01T00:00:00", "PriceArea": "DK1", "SpotPriceEUR": 10.5, "SpotPriceDKK": "x"},
        {"HourUTC": "2025-01-01 01:00:00", "PriceArea": "DK2", "SpotPriceEUR": None, "SpotPriceDKK": 7},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    rows = records.normalise_spot(records.read_payloads(spark, str(tmp_path))).orderBy("zone").collect()
    assert [(r.zone, r.price_eur_mwh, r.price_dkk_mwh) for r in rows] == [
        ("DK_1", 10.5, None), ("DK_2", None, 7.0),
    ]
    assert rows[1].ts_utc == dt.datetime(2025, 1, 1, 1)


def test_production_is_averaged_per_hour(spark):
    quarter = [
        {"HourUTC": f"2025-01-01T00:{m:02d}:00", "PriceArea": "DK1", "TotalLoad": m, "SolarPower": "n/a"}
        for m in (0, 15, 30, 45)
    ]
    df = spark.createDataFrame([(json.dumps({"records": quarter}),)], "payload string")
    made = records.normalise_production(df)
    row = made.first()
    assert row.total_load_mw == 22.5 and row.solar_mw is None and row.hydro_mw is None
    assert records.load_of(made).first().load_mw == 22.5
    assert records.wind_solar_of(made).columns[-3:] == ["wind_onshore_mw", "wind_offshore_mw", "solar_mw"]


def test_weather_autumn_hour_and_missing_variable(spark):
    local = ["2025-10-26T01:00", "2025-10-26T02:00", "2025-10-26T02:00", "2025-10-26T03:00"]
    body = {"hourly": {"time": local, "temperature_2m": [1, 2, 3, 4]}}
    df = spark.createDataFrame([("A", json.dumps(body))], "zone string, payload string")
    rows = records.normalise_weather(df).orderBy("temperature_2m").collect()
    assert [r.ts_utc for r in rows] == hours(4, dt.datetime(2025, 10, 25, 23))
    assert rows[0].wind_speed_10m is None


def test_headers_are_matched_by_word(spark):
    df = spark.createDataFrame(
        [("A", START, 1.0, 2.0)], "zone string, ts_utc timestamp_ntz, `Wind Offshore` double, Solar double"
    )
    row = records.normalise_transparency(df, "wind_solar_forecast").first()
    assert (row.wind_onshore_mw, row.wind_offshore_mw, row.solar_mw) == (0.0, 1.0, 2.0)


def write(path, name, text):
    (path / name).write_text(text, encoding="utf-8")


def test_exported_files_of_every_kind(spark, tmp_path):
    write(tmp_path, "prices.csv",
          '"MTU (CET/CEST)","Area","Day-ahead Price [EUR/MWh]"\n'
          '"30.03.2025 01:00 - 30.03.2025 03:00","BZN|DK1","10,5"\n'
          '"30.03.2025 03:00 - 30.03.2025 04:00","BZN|DK1","11.5"\n'
          '"30.03.2025 03:00 - 30.03.2025 04:00","BZN|DK1","12.5"\n'
          '"30.03.2025 04:00 - 30.03.2025 05:00","BZN|XX","99"\n')
    write(tmp_path, "wind_SE3.csv",
          "DateTime;Wind Onshore Generation;Solar\n2025-01-01 00:00;5;n/e\n\n")
    write(tmp_path, "Load_DE-LU.csv", "Date\tTime\tTotal Load\n01/02/2025\t03:00\t700\n")
    write(tmp_path, "physical_flow_DK1_NO2.csv", "DateTime,Physical Flow\n2025-01-01 00:00,-3\n")
    write(tmp_path, "unknown_DK1.csv", "DateTime,x\n2025-01-01 00:00,1\n")
    out = exports.import_exports(spark, str(tmp_path), "Europe/Copenhagen")
    price = out["day_ahead_prices"].collect()
    # "10,5" does not read as a number; the later line of an hour wins; XX is no zone
    assert [(r.zone, r.ts_utc, r.price_eur_mwh) for r in price] == [
        ("DK_1", dt.datetime(2025, 3, 30, 1), 12.5)
    ]
    wind = out["wind_solar_forecast"].first()
    assert (wind.zone, wind.ts_utc) == ("SE_3", dt.datetime(2024, 12, 31, 23))
    assert (wind.wind_onshore_mw, wind.wind_offshore_mw, wind.solar_mw) == (5.0, 0.0, None)
    load = out["load_forecast"].first()
    assert (load.zone, load.ts_utc, load.load_mw) == ("DE_LU", dt.datetime(2025, 2, 1, 2), 700.0)
    flow = out["flow"].first()
    assert (flow.from_zone, flow.to_zone, flow.flow_mw) == ("NO_2", "DK_1", -3.0)


def test_every_zone_is_known_and_rejects_are_counted(spark, tmp_path):
    for zone, _, code, *_ in dims.ZONES:
        last = zone.rpartition("_")[2]
        short = zone.replace("_", "" if last.isdigit() else "-")
        write(tmp_path, f"Load_x_{code}.csv", "DateTime,Total Load\n2025-01-01 00:00,1\n")
        write(tmp_path, f"load-{short}.csv", "DateTime,Total Load\n2025-01-01 01:00,2\n")
        write(tmp_path, f"load_area_{zone}.csv".replace(zone, "z" + str(len(zone) * 31)),
              f"DateTime,Area,Total Load\n2025-01-01 02:00,BZN|{short},3\n")
    write(tmp_path, "load_dated.csv", "DateTime,Total Load\n2025-01-01 00:00,1\n")
    write(tmp_path, "load_FI.csv", "DateTime,Total Load\nnoon,1\n2025-01-01 05:00,n/e\n2025-01-01 06:00,3\n")
    write(tmp_path, "other_FI.csv", "DateTime,x\n2025-01-01 00:00,1\n")
    out = exports.import_exports(spark, str(tmp_path), "UTC")
    zones = {r.zone for r in out["load_forecast"].where("load_mw < 3").collect()}
    assert zones == {z for z, *_ in dims.ZONES}
    assert {(r.file, r.reason, r.n_lines) for r in out["rejects"].collect()} == {
        ("load_dated.csv", "unknown area", 1), ("load_FI.csv", "unreadable time", 1),
        ("load_FI.csv", "unreadable value", 1), ("other_FI.csv", "unknown data type", 1),
    }


def test_header_found_in_a_split_file(spark, tmp_path):
    lines = ["MTU,Day-ahead Price"] + [f"2025-01-{1 + i // 24:02d} {i % 24:02d}:00,{i}" for i in range(240)]
    write(tmp_path, "DK2.csv", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        out = exports.import_exports(spark, str(tmp_path), "UTC")["day_ahead_prices"]
        assert exports.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        assert out.count() == 240 and out.agg(F.sum("price_eur_mwh")).first()[0] == sum(range(240))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dimensions(spark):
    assert dims.zones(spark).count() == 21 and dims.interconnectors(spark).count() == 40
    known = {r.zone for r in dims.zones(spark).collect()}
    ends = {z for r in dims.interconnectors(spark).collect() for z in (r.from_zone, r.to_zone)}
    assert ends <= known
    assert dims.feature_availability(spark).count() == 17


def test_records_are_cut_out_of_large_files(spark, tmp_path):
    record = lambda k: {"HourUTC": (START + dt.timedelta(hours=k // 2)).isoformat(), "PriceArea": f"DK{k % 2 + 1}",
                        "SpotPriceEUR": k, "SpotPriceDKK": None, "note": "x" * (k % 50)}
    first = {"total": 4000, "limit": {"n": 1}, "records": [record(k) for k in range(4000)]}
    (tmp_path / "a.json").write_text(json.dumps(first, indent=1))
    again = {"records": [record(0) | {"SpotPriceEUR": -1}, record(0) | {"SpotPriceEUR": -2}]}
    (tmp_path / "b.json").write_text(json.dumps(again) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"records": []}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = records.read_records(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 10  # one file, many tasks
        rows = records.normalise_spot(found)
        whole = records.normalise_spot(records.read_payloads(spark, str(tmp_path)))
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole.collect()))
        got = {(r.zone, r.ts_utc): r.price_eur_mwh for r in rows.collect()}
        assert len(got) == 4000 and got["DK_1", START] == -2.0 and got["DK_2", START] == 1.0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
