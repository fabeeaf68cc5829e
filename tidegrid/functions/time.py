"""Column functions for UTC storage, local calendars and daylight-saving days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_TZ = "Europe/Copenhagen"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_no(ts: Column | str) -> Column:
    """Whole hours since 1970-01-01 of a TIMESTAMP_NTZ; the grid coordinate."""
    ts = _col(ts)
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 24 + F.hour(ts)


def hour_ts(hour: Column | str) -> Column:
    """TIMESTAMP_NTZ at which hour number ``hour`` starts."""
    h = _col(hour)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole_days = F.floor(h / 24).cast("int")
    return epoch + F.make_dt_interval(whole_days, F.pmod(h, F.lit(24)).cast("int"))


def hour_floor(ts: Column | str) -> Column:
    """Start of the hour containing ``ts``."""
    return hour_ts(hour_no(ts))


def day_start(day: Column) -> Column:
    """Midnight of a date as TIMESTAMP_NTZ."""
    return _col(day).cast("timestamp_ntz")


def to_utc(local: Column | str, source_tz: str) -> Column:
    """UTC wall clock of a naive local timestamp; the zone must be named."""
    if not source_tz:
        raise ValueError("a naive timestamp needs an explicit source_tz")
    return F.convert_timezone(F.lit(source_tz), F.lit("UTC"), _col(local))


def to_local(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    """Local wall clock of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts))


def to_cet(ts: Column | str) -> Column:
    """Auction-clock time of a UTC timestamp."""
    return to_local(ts, MARKET_TZ)


def instant_to_utc(ts: Column | str) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) of a TIMESTAMP instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def local_date(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return to_local(ts, tz).cast("date")


def local_hour(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return F.hour(to_local(ts, tz))


def local_weekday(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(to_local(ts, tz))


def local_month(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return F.month(to_local(ts, tz))


def week_end(day: Column | str) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``day``."""
    return F.next_day(F.date_sub(_col(day), 1), "SUN")


def has_offset(text: Column | str) -> Column:
    """True when a landed timestamp string carries Z or a numeric offset."""
    return _col(text).rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def last_sunday(year: Column, month: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, F.pmod(F.weekday(end) + 1, F.lit(7)))


def expected_hours(day: Column | str) -> Column:
    """Hours in a local European day: 23 in spring, 25 in autumn, else 24."""
    day = _col(day)
    year = F.year(day)
    return (
        F.when(day == last_sunday(year, 3), F.lit(23))
        .when(day == last_sunday(year, 10), F.lit(25))
        .otherwise(F.lit(24))
    )


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the Meeus/Jones/Butcher rule, in integer columns."""
    golden = F.pmod(year, F.lit(19))
    century = _idiv(year, 100)
    in_century = F.pmod(year, F.lit(100))
    lunar_fix = _idiv(century - _idiv(century + 8, 25) + 1, 3)
    epact = F.pmod(golden * 19 + century - _idiv(century, 4) - lunar_fix + 15, F.lit(30))
    sunday = F.pmod(
        F.pmod(century, F.lit(4)) * 2
        + _idiv(in_century, 4) * 2
        - epact
        - F.pmod(in_century, F.lit(4))
        + 32,
        F.lit(7),
    )
    late = _idiv(golden + epact * 11 + sunday * 22, 451)
    serial = epact + sunday - late * 7 + 114
    return F.make_date(year, _idiv(serial, 31), F.pmod(serial, F.lit(31)) + 1)


# Danish public holidays as days from Easter Sunday, and the
# last year of Great Prayer Day (Easter + 26).
EASTER_HOLIDAYS = (-3, -2, 0, 1, 39, 49, 50)
PRAYER_DAY_OFFSET = 26
PRAYER_DAY_LAST_YEAR = 2023


def is_danish_holiday(day: Column | str) -> Column:
    day = _col(day)
    year = F.year(day)
    from_easter = F.date_diff(day, easter_sunday(year))
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    return (
        month_day.isin(101, 1225, 1226)
        | from_easter.isin(*EASTER_HOLIDAYS)
        | ((from_easter == PRAYER_DAY_OFFSET) & (year <= PRAYER_DAY_LAST_YEAR))
    )
