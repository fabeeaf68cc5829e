"""The stored series: one partitioned table per datatype.

Layout ``root/<datatype>/source=…/month=yyyy-MM/v=…`` with rows range-clustered
by zone and time. Directories do not multiply with zones (a zone-month is only
a few hundred rows), files stay full-sized, time filters prune directories and
zone filters prune row groups. Folders are never changed: an upsert writes new
ones for the months it touches and swaps them in by a manifest (``versions``).
Beside each month's rows stands its summary, one row per zone, swapped by the
same manifest; ranges, catalogue and missing chunks are answered from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.align import concat
from tidegrid.session import staged
from tidegrid.sources import versions
from tidegrid.sources.schemas import nan_to_null, series_schema

SERIES_KEYS = ("source", "zone", "ts_utc")
PARTITIONS = ("source", "month")
SERIES_MONTH = ("source", "zone", "month")

# Sources in order of preference.
SOURCE_PRIORITY = ("energinet", "entsoe")


def series_path(root: str, datatype: str) -> str:
    return f"{root.rstrip('/')}/{datatype}"


#: How often an upsert starts again when another writer was faster.
ATTEMPTS = 5
SUMMARY_SCHEMA = (
    "zone string, n_rows long, start timestamp_ntz, end timestamp_ntz, days int, "
    "source string, month string, v string"
)


def _part(source: str, month: str) -> str:
    return f"{source}\t{month}"


def _folders(
    manifest: versions.Manifest, kind: str, source: str | None, start: str | None, end: str | None
) -> list[str]:
    """The folders of one kind (rows or summary) that a source and a range of time need."""
    out = []
    for name, folder in sorted(manifest.parts.items()):
        of_kind, of_source, month = name.split("\t")
        if of_kind != kind or (source is not None and of_source != source):
            continue
        if (start is None or month >= start[:7]) and (end is None or month <= end[:7]):
            out.append(folder)
    return out


def read_series(
    spark: SparkSession,
    root: str,
    datatype: str,
    source: str | None = None,
    zones: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """Stored rows as of now or of an earlier ``version``; an absent table reads as an empty frame.

    The state is fixed when this is called: later upserts don't change what the
    frame reads. Source and month filters choose folders; zone and time filters
    reach the parquet reader. A table without a manifest, written by other
    means in ``source=…/month=…`` folders, is read as it stands.
    """
    schema = series_schema(datatype)
    path = series_path(root, datatype)
    manifest = versions.current(spark, path, version)
    try:
        if manifest.version:
            folders = _folders(manifest, "rows", source, start, end)
            df = spark.createDataFrame([], schema)
            if folders:
                reader = spark.read.schema(f"{_ddl(schema)}, v string").option("basePath", path)
                df = reader.parquet(*[f"{path}/{f}" for f in folders]).drop("v")
        else:
            df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if manifest.version or "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    if source is not None:
        df = df.where(F.col("source") == source)
    if zones is not None:
        df = df.where(F.col("zone").isin(*zones))
    if start is not None:
        df = df.where(F.col("month") >= start[:7]).where(
            F.col("ts_utc") >= F.lit(start).cast("timestamp_ntz")
        )
    if end is not None:
        df = df.where(F.col("month") <= end[:7]).where(
            F.col("ts_utc") <= F.lit(end).cast("timestamp_ntz")
        )
    return nan_to_null(df)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format(F.col("ts_utc").cast("date"), "yyyy-MM"))


def _replace(df: DataFrame, root: str, datatype: str, keys: Sequence[str]) -> None:
    """Put ``df`` in place of the stored rows with the same ``keys``.

    Only the touched (source, month) parts are read; the merged rows go to new
    folders with their summary, and one rename makes them the table. Readers
    see the old state or the new, and a job that fails leaves the old one. If
    another writer finishes first, the merge starts again from its state.
    """
    spark = df.sparkSession
    path = series_path(root, datatype)
    new = staged(with_month(df), f"new-{datatype}")
    # as many rows as folders are replaced; they choose what is read
    touched = [(r["source"], r["month"]) for r in new.select(*PARTITIONS).distinct().na.drop().collect()]
    if not touched:
        return
    for attempt in range(ATTEMPTS):
        try:
            return _swap(new, touched, path, datatype, keys)
        except versions.ConcurrentWrite:
            if attempt == ATTEMPTS - 1:
                raise


def _swap(
    new: DataFrame, touched: Sequence[tuple[str, str]], path: str, datatype: str, keys: Sequence[str]
) -> None:
    spark = new.sparkSession
    schema = series_schema(datatype)
    base = versions.current(spark, path)
    names = {(s, m): _part(s, m) for s, m in touched}
    folders = [f for n in names.values() if (f := base.parts.get(f"rows\t{n}"))]
    old = spark.createDataFrame([], schema)
    if folders:
        reader = spark.read.schema(f"{_ddl(schema)}, v string").option("basePath", path)
        old = reader.parquet(*[f"{path}/{f}" for f in sorted(folders)]).drop("v")
    version = uuid.uuid4().hex
    merged = merge_series(nan_to_null(old), new, keys).withColumn("v", F.lit(version))
    (
        merged.where(F.col("source").isNotNull() & F.col("month").isNotNull())
        .repartitionByRange(*PARTITIONS, "zone", "ts_utc")
        .sortWithinPartitions(*PARTITIONS, "zone", "ts_utc")
        .write.mode("append").partitionBy(*PARTITIONS, "v").parquet(path)
    )
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    place = {n: f"source={escape(s)}/month={escape(m)}/v={version}" for (s, m), n in names.items()}
    reader = spark.read.schema(f"{_ddl(schema)}, v string").option("basePath", path)
    written = reader.parquet(*[f"{path}/{f}" for f in place.values()])
    (
        summary_of(written).withColumn("v", F.lit(version)).repartition(*PARTITIONS)
        .write.mode("append").partitionBy(*PARTITIONS, "v").parquet(f"{path}/summary")
    )
    changed = {f"rows\t{n}": f for n, f in place.items()}
    changed |= {f"summary\t{n}": f"summary/{f}" for n, f in place.items()}
    versions.commit(spark, path, base, changed)


def summary_of(rows: DataFrame) -> DataFrame:
    """Per source, zone and month: rows, first and last hour, and the days of the month that have
    rows, as bits (bit 1 is the first)."""
    day = F.expr("shiftleft(1, dayofmonth(CAST(ts_utc AS DATE)))")
    return rows.groupBy(*SERIES_MONTH).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts_utc").alias("start"), F.max("ts_utc").alias("end"),
        F.bit_or(day).alias("days"),
    )


def stored_summary(
    spark: SparkSession, root: str, datatype: str, version: int | None = None
) -> DataFrame:
    """The maintained summary of a stored series (``summary_of`` its rows); reads no row files."""
    path = series_path(root, datatype)
    folders = _folders(versions.current(spark, path, version), "summary", None, None, None)
    if not folders:
        return spark.createDataFrame([], SUMMARY_SCHEMA).drop("v")
    reader = spark.read.schema(SUMMARY_SCHEMA).option("basePath", f"{path}/summary")
    return reader.parquet(*[f"{path}/{f}" for f in folders]).drop("v")


def stored_coverage(
    spark: SparkSession, root: str, datatype: str, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``coverage`` of a stored series, from its summary."""
    return _coverage_of(stored_summary(spark, root, datatype), by)


def _coverage_of(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def stored_covers(
    spark: SparkSession, root: str, datatype: str, start: str, end: str, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``covers`` of a stored series, from its summary."""
    return _covered(stored_coverage(spark, root, datatype, by), start, end)


def stored_catalogue(spark: SparkSession, root: str, datatypes: Sequence[str]) -> DataFrame:
    """``catalogue`` of stored series, from their summaries."""
    parts = [
        stored_summary(spark, root, name)
        .groupBy("source", "zone")
        .agg(F.sum("n_rows").alias("n_rows"), F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("datatype", F.lit(name))
        for name in datatypes
    ]
    return concat(*parts)


def stored_missing_chunks(
    spark: SparkSession, root: str, datatype: str, start: str, end: str, step: str = "365 days",
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """``missing_chunks`` of a stored series: chunks are whole days, and the summary knows the days."""
    summary = stored_summary(spark, root, datatype)
    bits = F.expr("filter(sequence(1, 31), d -> (days & shiftleft(1, d)) != 0)")
    first = F.to_date(F.concat("month", F.lit("-01")))
    days = summary.select(*by, first.alias("_first"), F.explode(bits).alias("_d")).select(
        *by, F.date_add("_first", F.col("_d") - 1).alias("ts_utc")
    )
    return missing_chunks(days, start, end, step, by)


def drop_unused(
    spark: SparkSession, root: str, datatype: str, keep: int = 2, older_than_hours: float = 24
) -> int:
    """Delete folders that the last ``keep`` versions of a series don't use."""
    path = series_path(root, datatype)
    rows = versions.drop_unused(spark, path, "source=*/month=*/v=*", keep, older_than_hours)
    return rows + versions.drop_unused(spark, path, "summary/source=*/month=*/v=*", keep, older_than_hours)


def write_series(df: DataFrame, root: str, datatype: str) -> None:
    """Overwrite the series-months present in ``df``; other zones' rows and
    other months stay."""
    _replace(df, root, datatype, SERIES_MONTH)


def merge_into(df: DataFrame, root: str, datatype: str) -> None:
    """Upsert ``df`` into the stored table by source, zone and timestamp."""
    _replace(df, root, datatype, SERIES_KEYS)


def merge_series(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = SERIES_KEYS
) -> DataFrame:
    """Old rows without a new counterpart, plus all new rows."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return concat(kept, new)


def coverage(df: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """First and last stored timestamp per series."""
    return df.groupBy(*by).agg(F.min("ts_utc").alias("start"), F.max("ts_utc").alias("end"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, start and end per source, zone and datatype."""
    parts = [
        df.groupBy("source", "zone")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("ts_utc").alias("start"),
            F.max("ts_utc").alias("end"),
        )
        .withColumn("datatype", F.lit(name))
        for name, df in tables.items()
    ]
    return concat(*parts)


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def covers(df: DataFrame, start: str, end: str, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Per series: does the stored range contain ``[start, end − 1 h]``?"""
    return _covered(coverage(df, by), start, end)


def _covered(ranges: DataFrame, start: str, end: str) -> DataFrame:
    last = _ts(end) - F.expr("INTERVAL 1 HOUR")
    return ranges.withColumn("covered", (F.col("start") <= _ts(start)) & (F.col("end") >= last))


def missing_chunks(
    df: DataFrame, start: str, end: str, step: str = "365 days", by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Chunks of ``[start, end)`` in which a series has no stored row.

    ``step`` is ``'n days'`` or ``'n months'``; the last chunk is clamped to
    ``end``. Returns ``by…, chunk_start, chunk_end`` (end exclusive). The chunk
    list depends only on the range, so it is attached as an array and exploded.
    """
    n, unit = step.split()
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    last = F.date_sub(hi, 1)
    if unit.startswith("month"):
        starts = F.sequence(lo, last, F.expr(f"INTERVAL {int(n)} MONTHS"))
        chunk_end = F.least(hi, F.add_months(F.col("chunk_start"), int(n)))
        months = F.floor(
            F.months_between(F.col("_day"), lo, roundOff=False) / int(n)
        ).cast("int")
        home = F.add_months(lo, months * int(n))
    else:
        starts = F.sequence(lo, last, F.expr(f"INTERVAL {int(n)} DAYS"))
        chunk_end = F.least(hi, F.date_add("chunk_start", int(n)))
        home = F.date_add(lo, (F.floor(F.date_diff(F.col("_day"), lo) / int(n)) * int(n)).cast("int"))
    days = df.select(*by, F.col("ts_utc").cast("date").alias("_day")).distinct()
    inside = (F.col("_day") >= lo) & (F.col("_day") < hi)
    present = days.where(inside).select(*by, home.alias("chunk_start")).distinct()
    wanted = (
        df.select(*by)
        .distinct()
        .withColumn("chunk_start", F.explode(starts))
        .withColumn("chunk_end", chunk_end)
    )
    return wanted.join(present, [*by, "chunk_start"], "left_anti")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Back-test summary records (JSON array) with status ``ok``, renamed."""
    schema = (
        "zone string, status string, total_pnl double, sharpe_ratio double, "
        "win_rate_pct double, n_trades long, n_test_days long"
    )
    return ok_summary(spark.read.schema(schema).option("multiLine", True).json(path))


def ok_summary(records: DataFrame) -> DataFrame:
    return records.where(F.col("status") == "ok").select(
        "zone",
        F.col("total_pnl").alias("backtest_pnl"),
        F.col("sharpe_ratio").alias("sharpe"),
        F.col("win_rate_pct").alias("win_pct"),
        F.col("n_trades").alias("trades"),
        "n_test_days",
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report sink: ``csv`` (with header), ``json`` or ``parquet``."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
