"""Manually exported delimiter-separated files → canonical series.

One job reads every file: lines arrive as text with their file name. What
depends on a file only (header, delimiter, data type, column positions) is
worked out once per file and joined to its lines, which then need one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.time import to_utc
from tidegrid.operators.align import dedup
from tidegrid.session import staged
from tidegrid.sources.dims import ZONES

#: Zones whose names are looked for first, in order of precedence (fixed values).
FIRST_ZONES = ("NO_2", "SE_3", "SE_4", "DE_LU", "DK_1", "DK_2")


def _area_codes() -> dict[str, str]:
    """Area code -> zone: each zone's short name, the same as a bidding zone, and its code."""
    codes = {zone: code for zone, _, code, *_ in ZONES}
    out = {}
    for zone in [*FIRST_ZONES, *(z for z in codes if z not in FIRST_ZONES)]:
        last = zone.rpartition("_")[2]
        short = zone.replace("_", "" if last.isdigit() else "-")
        out |= {short: zone, f"BZN|{short}": zone, codes[zone]: zone}
    return out


AREA_MAP = _area_codes()
# Header names of area and time columns.
AREA_COLUMNS = ("Area", "MapCode", "AreaCode", "BiddingZone")
TIME_COLUMNS = ("DateTime", "Date", "Time (UTC)", "Timestamp")
DELIMITERS = ("\t", ",", ";")
TIME_FORMATS = (
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as ``file, line_no, value``; ``line_no`` orders a file's
    lines, so the smallest one is the header whatever the file splits."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.regexp_replace(F.col("value"), "^﻿", "").alias("value"),
    )
    return raw.where(F.trim("value") != "")


def _cells(text: Column, delimiter: Column) -> Column:
    """A line cut at its delimiter outside double quotes, quotes removed."""
    out = F.array(text)
    for d in DELIMITERS:
        parts = F.split(text, f'{d}(?=(?:[^"]*"[^"]*")*[^"]*$)')
        out = F.when(delimiter == d, parts).otherwise(out)
    return F.transform(out, lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def _position(test: str) -> Column:
    """1-based position of the first header ``h`` for which ``test`` holds."""
    return F.expr(f"nullif(array_position(transform(lowered, h -> {test}), true), 0)")


def _last_position(test: str) -> Column:
    flags = f"reverse(transform(lowered, h -> {test}))"
    return F.expr(f"size(lowered) + 1 - nullif(array_position({flags}, true), 0)")


def _named(name: str) -> Column:
    return F.expr(f"nullif(array_position(header, '{name}'), 0)")


_OFFSHORE = "(contains(h, 'offshore') AND contains(h, 'wind'))"
_ONSHORE = f"""(NOT {_OFFSHORE} AND contains(h, 'wind') AND (contains(h, 'onshore')
  OR contains(h, 'forecast') OR contains(h, 'generation')))"""
_SOLAR = f"""(NOT {_OFFSHORE} AND NOT {_ONSHORE}
  AND (contains(h, 'solar') OR contains(h, 'photovoltaic')))"""


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _in_name(code: str) -> str:
    """SQL: the file name has the code; one of letters only must stand by itself."""
    if code.isalpha():
        return f"upper(file) RLIKE '(^|[^A-Z0-9]){code}([^A-Z0-9]|$)'"
    return f"contains(upper(file), '{code}')"


def _zone_hits() -> str:
    """SQL array of the zones whose area code occurs in the file name."""
    return "array(" + ", ".join(
        f"CASE WHEN {_in_name(code)} THEN '{zone}' END" for code, zone in AREA_MAP.items()
    ) + ")"


def zone_from_file() -> Column:
    """First known area code contained in ``file``; a ``|`` may read ``_``."""
    hits = ", ".join(
        f"CASE WHEN {_in_name(code)} OR {_in_name(code.replace('|', '_'))} THEN '{zone}' END"
        for code, zone in AREA_MAP.items()
    )
    return F.expr(f"coalesce({hits})")


def flow_zones() -> Column:
    """Known area codes in a flow file's name, in the order of the area table:
    the first is the from zone and the last the to zone."""
    return F.expr(f"filter({_zone_hits()}, z -> z IS NOT NULL)")


def detect_data_type() -> Column:
    """Data type of a file from its name and headers."""
    name = "lower(file)"

    def header(*words: str) -> str:
        return f"exists(lowered, h -> {_any('h', words)})"

    return F.expr(
        f"""CASE WHEN {_any(name, ["price"])} OR {header("price")} THEN 'prices'
                 WHEN {_any(name, ["generation", "wind", "solar"])} THEN 'generation'
                 WHEN {_any(name, ["load"])} THEN 'load'
                 WHEN {_any(name, ["flow", "physical"])} THEN 'flow'
                 WHEN {header("day-ahead")} THEN 'prices'
                 WHEN {header("wind", "solar")} THEN 'generation'
                 WHEN {header("load")} THEN 'load'
                 ELSE 'unknown' END"""
    )


def file_facts(lines: DataFrame) -> DataFrame:
    """One row per file: header line, delimiter, data type, column positions."""
    heads = lines.groupBy("file").agg(F.min_by("value", "line_no").alias("head"))
    mark = F.lit(None).cast("string")
    for d in reversed(DELIMITERS):
        mark = F.when(F.col("head").contains(d), F.lit(d)).otherwise(mark)
    cut = heads.withColumn("delimiter", F.coalesce(mark, F.lit(","))).withColumn(
        "header", _cells(F.col("head"), F.col("delimiter"))
    )
    lowered = cut.withColumn("lowered", F.transform("header", F.lower))
    return lowered.withColumn("pair", flow_zones()).select(
        "file",
        "head",
        "delimiter",
        detect_data_type().alias("data_type"),
        zone_from_file().alias("file_zone"),
        F.expr("get(pair, 0)").alias("from_zone"),
        F.expr("CASE WHEN size(pair) > 1 THEN element_at(pair, -1) END").alias("to_zone"),
        F.array(*[_named(c) for c in AREA_COLUMNS]).alias("area_at"),
        _position("contains(h, 'mtu')").alias("mtu_at"),
        _named("Date").alias("date_at"),
        _named("Time").alias("clock_at"),
        F.coalesce(*[_named(c) for c in TIME_COLUMNS]).alias("time_at"),
        _position(_any("h", ["price", "day-ahead"])).alias("price_at"),
        _position(_any("h", ["load", "forecast"])).alias("load_at"),
        _position("contains(h, 'flow') OR h RLIKE '[0-9]'").alias("flow_at"),
        _last_position(_ONSHORE).alias("wind_onshore_mw_at"),
        _last_position(_OFFSHORE).alias("wind_offshore_mw_at"),
        _last_position(_SOLAR).alias("solar_mw_at"),
    )


def _cell(position: str) -> str:
    """SQL for the cell at a 1-based position; NULL or a short line → NULL."""
    return f"get(cells, CAST({position} AS INT) - 1)"


def split_lines(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Data lines with their file's facts and ``cells``. Spark picks broadcast
    or shuffle for the per-file side by its measured size."""
    joined = lines.join(facts, "file").where(F.col("value") != F.col("head"))
    return joined.withColumn("cells", _cells(F.col("value"), F.col("delimiter"))).drop(
        "value", "head", "delimiter"
    )


def detect_zone() -> Column:
    """Zone of a line: by area column when its code is known, else file name."""
    known = "map(" + ", ".join(f"'{code}', '{zone}'" for code, zone in AREA_MAP.items()) + ")"
    by_area = ", ".join(
        f"try_element_at({known}, {_cell(f'get(area_at, {i})')})" for i in range(len(AREA_COLUMNS))
    )
    return F.expr(f"coalesce({by_area}, file_zone)")


def parse_export_time(text: str, source_tz: str) -> Column:
    """UTC wall clock of an exported time: range start, day first."""
    start = f"trim(split({text}, ' - ')[0])"
    quoted = [f.replace("'", "\\'") for f in TIME_FORMATS]
    tried = ", ".join(
        f"CAST(try_to_timestamp({start}, '{f}') AS TIMESTAMP_NTZ)" for f in quoted
    )
    return to_utc(F.expr(f"coalesce({tried})"), source_tz)


def _time_text() -> str:
    two_columns = f"concat_ws(' ', {_cell('date_at')}, {_cell('clock_at')})"
    return (
        f"coalesce({_cell('mtu_at')}, CASE WHEN clock_at IS NOT NULL THEN {two_columns} END, "
        f"{_cell('time_at')})"
    )


def classified(lines: DataFrame, source_tz: str, data_type: str | None = None) -> DataFrame:
    """Every data line with its zone, data type and UTC time; lines of other
    data types drop out at the per-file join."""
    facts = file_facts(lines)
    if data_type is not None:
        facts = facts.where(F.col("data_type") == data_type)
    return split_lines(lines, facts).withColumns(
        {"zone": detect_zone(), "ts_utc": parse_export_time(_time_text(), source_tz)}
    )


def _value(position: str) -> Column:
    """Number in the named column, else the first cell that reads as one."""
    numbers = "filter(cells, c -> try_cast(c AS DOUBLE) IS NOT NULL)"
    return F.expr(
        f"try_cast(CASE WHEN {position} IS NOT NULL THEN {_cell(position)} "
        f"ELSE get({numbers}, 0) END AS DOUBLE)"
    )


KINDS = ("wind_onshore_mw", "wind_offshore_mw", "solar_mw")


def import_table(
    lines: DataFrame, datatype: str, source_tz: str, source: str = "entsoe"
) -> DataFrame:
    """One canonical table from exported lines, last line of an hour winning.

    ``datatype`` is ``day_ahead_prices``, ``wind_solar_forecast``,
    ``load_forecast`` or ``flow``. Lines without a known zone or readable time
    are left out; rows whose value does not read as a number too, except that a
    wind/solar series absent from the header is 0. ``rejects`` counts them.
    """
    file_type, values = _tables()[datatype]
    keys = ["from_zone", "to_zone", "ts_utc"] if datatype == "flow" else ["zone", "ts_utc"]
    rows = classified(lines, source_tz, file_type).where("zone IS NOT NULL")
    picked = rows.select(
        F.lit(source).alias("source"), *keys, *[c.alias(n) for n, c in values.items()],
        F.struct("file", "line_no").alias("_seq"),
    )
    needed = keys if datatype == "wind_solar_forecast" else [*keys, *values]
    whole = picked.na.drop(subset=needed)
    return dedup(whole, "_seq", "last", ["source", *keys]).drop("_seq")


def _tables() -> dict[str, tuple[str, dict[str, Column]]]:
    """Stored table -> the files' data type and the value columns."""
    return {
        "day_ahead_prices": ("prices", {"price_eur_mwh": _value("price_at")}),
        "load_forecast": ("load", {"load_mw": _value("load_at")}),
        "flow": ("flow", {"flow_mw": _value("flow_at")}),
        "wind_solar_forecast": ("generation", {k: _kind(k) for k in KINDS}),
    }


def rejects(lines: DataFrame, source_tz: str) -> DataFrame:
    """Data lines that no table takes: ``file, reason, n_lines``."""
    rows = classified(lines, source_tz)
    whole = F.lit(True)
    for datatype, (file_type, values) in _tables().items():
        if datatype != "wind_solar_forecast":
            known = F.coalesce(*values.values()).isNotNull()
            whole = F.when(F.col("data_type") == file_type, known).otherwise(whole)
    no_area = F.when(
        F.col("data_type") == "flow", F.col("from_zone").isNull() | F.col("to_zone").isNull()
    ).otherwise(F.col("zone").isNull())
    reason = (
        F.when(F.col("data_type") == "unknown", "unknown data type")
        .when(no_area, "unknown area")
        .when(F.col("ts_utc").isNull(), "unreadable time")
        .when(~whole, "unreadable value")
    )
    return (
        rows.withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .groupBy("file", "reason")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def _kind(name: str) -> Column:
    return F.expr(
        f"CASE WHEN {name}_at IS NULL THEN 0D ELSE try_cast({_cell(name + '_at')} AS DOUBLE) END"
    )


def import_exports(spark: SparkSession, path: str, source_tz: str) -> dict[str, DataFrame]:
    """All exported files under ``path`` as canonical tables, and ``rejects``.

    The text is read once: lines are written with their place, and the tables
    come from that.
    """
    lines = staged(read_lines(spark, path), "export-lines")
    out = {name: import_table(lines, name, source_tz) for name in _tables()}
    return out | {"rejects": rejects(lines, source_tz)}
