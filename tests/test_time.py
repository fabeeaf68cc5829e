import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import time as T
from tidegrid.operators import quality


def column(spark, values, expr, kind="date"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, d {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("d"))).collect()]


def test_easter(spark):
    years = [1992, 1999, 2000, 2008, 2011, 2024, 2025, 2038]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    got = [r[0].strftime("%m-%d") for r in df.select(T.easter_sunday(F.col("y"))).collect()]
    assert got == ["04-19", "04-04", "04-23", "03-23", "04-24", "03-31", "04-20", "04-25"]


def test_danish_holidays(spark):
    D = dt.date
    yes = [D(2024, 1, 1), D(2024, 3, 28), D(2024, 3, 29), D(2024, 4, 1), D(2024, 5, 9),
           D(2024, 5, 20), D(2024, 12, 25), D(2024, 12, 26), D(2023, 5, 5)]
    no = [D(2024, 4, 26), D(2024, 12, 24), D(2024, 6, 5), D(2024, 3, 30)]
    assert all(column(spark, yes, T.is_danish_holiday))
    assert not any(column(spark, no, T.is_danish_holiday))


def test_expected_hours(spark):
    days = [dt.date(2025, 3, 30), dt.date(2025, 10, 26), dt.date(2025, 3, 29), dt.date(2024, 10, 27)]
    assert column(spark, days, T.expected_hours) == [23, 25, 24, 25]


def test_transitions(spark):
    years = spark.createDataFrame([(2024,), (2025,)], "year int")
    got = {(r.year, r.type): (r.date, r.hours) for r in quality.dst_transitions(years).collect()}
    assert got[2024, "spring_forward"] == (dt.date(2024, 3, 31), 23)
    assert got[2024, "fall_back"] == (dt.date(2024, 10, 27), 25)
    assert got[2025, "spring_forward"] == (dt.date(2025, 3, 30), 23)


def test_conversion_and_hour_numbers(spark):
    stamps = [dt.datetime(2025, 6, 1, 22, 30), dt.datetime(1969, 12, 31, 23, 59)]
    assert column(spark, stamps, T.to_cet, "timestamp_ntz")[0] == dt.datetime(2025, 6, 2, 0, 30)
    assert column(spark, stamps, lambda c: T.to_utc(c, T.MARKET_TZ), "timestamp_ntz")[0] == (
        dt.datetime(2025, 6, 1, 20, 30)
    )
    assert column(spark, stamps, T.hour_floor, "timestamp_ntz") == [
        dt.datetime(2025, 6, 1, 22), dt.datetime(1969, 12, 31, 23),
    ]
    with pytest.raises(ValueError):
        T.to_utc(F.col("d"), "")


def test_session_time_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    stamps = [dt.datetime(2025, 3, 30, 2, 30)]  # does not exist in Copenhagen
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Copenhagen")
        assert column(spark, stamps, T.hour_floor, "timestamp_ntz") == [dt.datetime(2025, 3, 30, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_week_end_and_offset(spark):
    days = [dt.date(2025, 1, 6), dt.date(2025, 1, 12), dt.date(2025, 1, 13)]
    assert [d.day for d in column(spark, days, T.week_end)] == [12, 12, 19]
    texts = ["2025-01-01T00:00:00Z", "2025-01-01 00:00+01:00", "2025-01-01 00:00"]
    assert column(spark, texts, T.has_offset, "string") == [True, True, False]
