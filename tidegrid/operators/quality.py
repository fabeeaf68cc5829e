"""Imputation with an audit trail, completeness, rule checks and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.time import (
    MARKET_TZ,
    expected_hours,
    has_offset,
    hour_no,
    last_sunday,
    local_date,
)
from tidegrid.operators.align import align_to, dedup, gaps, hour_span
from tidegrid.operators.blocks import attach, frame_moments, trailing_rows
from tidegrid.operators.screen import out_of_range

# Quality gates in percent, and the outlier count worth a warning.
MIN_COMPLETENESS_PCT = 90.0
MAX_IMPUTATION_PCT = 5.0
MAX_OUTLIERS = 10


def impute_ffill(
    df: DataFrame,
    cols: Sequence[str],
    limit: int = 6,
    datatype: str = "series",
    by: Sequence[str] = ("zone",),
) -> tuple[DataFrame, DataFrame]:
    """Forward fill of at most ``limit`` rows per gap, with its audit rows.

    In a longer gap the first ``limit`` rows are filled and the rest stay NULL.
    The audit has one row per filled value: ``by…, datatype, column, ts_utc, method``.
    """

    def build(w):
        frame = w.rowsBetween(-limit, 0)
        filled = {c: F.last(c, ignorenulls=True).over(frame) for c in cols}
        was_null = {f"_was_null_{c}": F.col(c).isNull() for c in cols}
        return {**was_null, **filled}

    both = trailing_rows(df, limit, build, by)
    result = both.select(*df.columns)
    marks = F.array(
        *[
            F.when(F.col(f"_was_null_{c}") & F.col(c).isNotNull(), F.lit(c))
            for c in cols
        ]
    )
    audit = both.select(
        *by,
        F.lit(datatype).alias("datatype"),
        F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("column"),
        "ts_utc",
        F.lit(f"ffill (max {limit}h)").alias("method"),
    )
    return result, audit


def audit_counts(audit: DataFrame, top: int | None = None) -> DataFrame:
    """Imputed values per datatype and column, most first; optional top list."""
    counts = audit.groupBy("datatype", "column").agg(F.count(F.lit(1)).alias("n_imputed"))
    if top is None:
        return counts
    return counts.orderBy(F.desc("n_imputed"), "datatype", "column").limit(top)


def clean_series(
    df: DataFrame, cols: Sequence[str], order: str, datatype: str, ref: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Dedup keep-first, limited fill, drop rows still incomplete, align to ``ref``."""
    unique = dedup(df, order).select("zone", "ts_utc", *cols)
    filled, audit = impute_ffill(unique, cols, datatype=datatype)
    whole = filled.na.drop(subset=list(cols))
    return (align_to(whole, ref) if ref is not None else whole), audit


def load_all(
    tables: dict[str, tuple[DataFrame, Sequence[str]]], order: str = "ingest_no"
) -> dict[str, DataFrame]:
    """Prices deduplicated; every other dataset cleaned and aligned to prices.

    ``tables`` maps dataset name to (rows, value columns) and must hold
    ``prices``. The result adds ``imputation_log``.
    """
    price_rows, price_cols = tables["prices"]
    prices = dedup(price_rows, order).select("zone", "ts_utc", *price_cols)
    out: dict[str, DataFrame] = {"prices": prices}
    audits = []
    for name, (rows, cols) in tables.items():
        if name == "prices":
            continue
        out[name], audit = clean_series(rows, cols, order, name, prices)
        audits.append(audit)
    if audits:
        out["imputation_log"] = reduce(DataFrame.unionByName, audits)
    return out


# ---------------------------------------------------------------- rule checks

# Expected columns per dataset and their type group.
RULES = {
    "prices": {"price_eur_mwh": "float"},
    "wind_solar": {"wind_onshore_mw": "float", "wind_offshore_mw": "float", "solar_mw": "float"},
    "load": {"load_mw": "float"},
}

_PATTERN = {
    "float": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
    "numeric": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
    "int": r"^\s*[+-]?\d+\s*$",
}


def quality_rules(
    df: DataFrame,
    dataset: str,
    rules: dict[str, str] | None = None,
    at_least_one: bool | None = None,
) -> DataFrame:
    """Error rows ``dataset, zone, column, error, n_rows`` from one aggregate.

    Errors: ``missing`` (no such column, or none of an at-least-one group),
    ``empty`` (no value present) and ``wrong_type`` (values that do not read as
    the rule's type). ``wind_solar`` needs only one of its columns.
    """
    rules = rules if rules is not None else RULES[dataset]
    any_of = at_least_one if at_least_one is not None else dataset == "wind_solar"
    present = [c for c in rules if c in df.columns]
    absent = [] if any_of and present else [c for c in rules if c not in df.columns]

    aggs = [F.count(F.lit(1)).alias("n")]
    for c in present:
        aggs.append(F.count(c).alias(f"v_{c}"))
        if rules[c] != "any":
            text = F.col(c).cast("string")
            bad = F.col(c).isNotNull() & ~text.rlike(_PATTERN[rules[c]])
            aggs.append(F.count_if(bad).alias(f"b_{c}"))
    counted = df.groupBy("zone").agg(*aggs)

    def finding(column: str, error: str, hit, n):
        return F.when(
            hit,
            F.struct(F.lit(column).alias("column"), F.lit(error).alias("error"), n.alias("n_rows")),
        )

    found = [finding(c, "missing", F.lit(True), F.col("n")) for c in absent]
    for c in present:
        found.append(finding(c, "empty", F.col(f"v_{c}") == 0, F.col("n")))
        if rules[c] != "any":
            found.append(finding(c, "wrong_type", F.col(f"b_{c}") > 0, F.col(f"b_{c}")))
    hits = F.filter(F.array(*found), lambda f: f.isNotNull())
    return counted.select("zone", F.explode(hits).alias("_f")).select(
        F.lit(dataset).alias("dataset"), "zone", "_f.column", "_f.error", "_f.n_rows"
    )


def naive_timestamps(df: DataFrame, text_col: str) -> DataFrame:
    """Per zone: landed timestamp strings that carry no offset."""
    return df.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~has_offset(text_col)).alias("n_without_offset"),
    )


# --------------------------------------------------------------- completeness


def daily_completeness(
    df: DataFrame, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Stored rows against expected hours for every local day that has rows."""
    counts = df.groupBy(*by, local_date("ts_utc", day_tz).alias("local_date")).agg(
        F.count(F.lit(1)).alias("actual")
    )
    expected = expected_hours("local_date")
    return counts.select(
        *by,
        "local_date",
        expected.alias("expected"),
        "actual",
        (expected - F.col("actual")).alias("missing"),
        (F.col("actual") >= expected).alias("complete"),
    )


def dst_transitions(
    years: DataFrame, year: str = "year", keep: Sequence[str] = ()
) -> DataFrame:
    """Both clock changes of each year: date, type and hours of the day."""
    y = F.col(year)
    change = F.explode(
        F.array(
            F.struct(
                last_sunday(y, 3).alias("date"),
                F.lit("spring_forward").alias("type"),
                F.lit(23).alias("hours"),
            ),
            F.struct(
                last_sunday(y, 10).alias("date"),
                F.lit("fall_back").alias("type"),
                F.lit(25).alias("hours"),
            ),
        )
    )
    return years.select(*keep, year, change.alias("_c")).select(
        *keep, year, "_c.date", "_c.type", "_c.hours"
    )


def dst_day_errors(
    df: DataFrame, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Clock-change days inside each series whose row count is wrong.

    A clock-change day with no rows at all counts as 0 rows.
    """
    day = local_date("ts_utc", day_tz)
    counts = df.groupBy(*by, day.alias("date")).agg(F.count(F.lit(1)).alias("actual"))
    span = counts.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    years = span.withColumn("year", F.explode(F.sequence(F.year("_lo"), F.year("_hi"))))
    return (
        dst_transitions(years, keep=[*by, "_lo", "_hi"])
        .where(F.col("date").between(F.col("_lo"), F.col("_hi")))
        .join(counts, [*by, "date"], "left")
        .select(
            *by, "date", "type", "hours", F.coalesce("actual", F.lit(0)).alias("actual")
        )
        .where(F.col("actual") != F.col("hours"))
    )


def completeness(
    df: DataFrame, by: Sequence[str] = ("zone",), gate_pct: float = MIN_COMPLETENESS_PCT
) -> DataFrame:
    """Rows against 24 per whole day between first and last timestamp, gated."""
    whole_days = F.floor(
        (hour_no(F.max("ts_utc")) - hour_no(F.min("ts_utc"))
         + _sub_hour(F.max("ts_utc")) - _sub_hour(F.min("ts_utc"))) / 24
    ) + 1
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("actual_hours"), (whole_days * 24).alias("expected_hours")
    )
    pct = F.col("actual_hours") / F.col("expected_hours") * 100
    return out.withColumn("completeness_pct", pct).withColumn(
        "passes", F.col("completeness_pct") >= gate_pct
    )


def _sub_hour(ts):
    return (F.minute(ts) * 60 + F.second(ts)) / F.lit(3600.0)


def hourly_coverage(df: DataFrame, col: str, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Share of grid hours that hold a value, capped at 100 %."""
    covered = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, hour_no("ts_utc").alias("_h"))
        .agg(F.lit(1).alias("_one"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("covered_hours"))
    )
    span = hour_span(df, by).select(
        *by, (F.col("last_hour") - F.col("first_hour") + 1).alias("grid_hours")
    )
    pct = F.coalesce(F.col("covered_hours"), F.lit(0)) / F.col("grid_hours") * 100
    return span.join(covered, list(by), "left").select(
        *by,
        F.coalesce("covered_hours", F.lit(0)).alias("covered_hours"),
        "grid_hours",
        F.least(pct, F.lit(100.0)).alias("coverage_pct"),
    )


def imputation_gate(
    prices: DataFrame, audit: DataFrame, max_pct: float = MAX_IMPUTATION_PCT
) -> DataFrame:
    """Imputed values per stored price hour, with a warning above the gate."""
    hours = prices.groupBy("zone").agg(F.count(F.lit(1)).alias("n_hours"))
    filled = audit.groupBy("zone").agg(F.count(F.lit(1)).alias("n_imputed"))
    pct = F.col("n_imputed") / F.col("n_hours") * 100
    return (
        hours.join(filled, "zone", "left")
        .withColumn("n_imputed", F.coalesce("n_imputed", F.lit(0)))
        .withColumn("imputed_pct", pct)
        .withColumn("warns", F.col("imputed_pct") > max_pct)
    )


# ------------------------------------------------------------------- outliers


def detect_outliers(
    df: DataFrame,
    col: str = "price_eur_mwh",
    window_days: int = 7,
    z_threshold: float = 3.0,
    extreme_high_threshold: float = 500.0,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Positive spikes by trailing z-score, and extreme highs.

    The window holds the last ``window_days·24`` rows including the current one
    and needs 24 values. Negative prices are never flagged.
    """
    span = window_days * 24

    def build(w):
        seen, mean, deviation = frame_moments(col, -(span - 1), 0)
        return {
            "rolling_mean": F.when(seen >= 24, mean),
            "rolling_std": F.nullif(F.when(seen >= 24, deviation), F.lit(0.0)),
        }

    rows = trailing_rows(df.select(*by, "ts_utc", col), span - 1, build, by, moments=[(col, -(span - 1), 0)])
    z = (F.col(col) - F.col("rolling_mean")) / F.col("rolling_std")
    extreme = F.coalesce(F.col(col) > extreme_high_threshold, F.lit(False))
    spike = F.coalesce(F.col("z_score") > z_threshold, F.lit(False))
    return (
        rows.withColumn("z_score", z)
        .withColumn("is_outlier", extreme | spike)
        .withColumn(
            "reason",
            F.when(extreme, F.lit(f"Extreme high spike: > {extreme_high_threshold} EUR/MWh"))
            .when(spike, F.lit(f"Positive spike: z-score > {z_threshold}"))
            .otherwise(F.lit("")),
        )
    )


# ----------------------------------------------------------------- zone gates


def zone_quality(
    prices: DataFrame,
    wind_solar: DataFrame,
    load: DataFrame,
    audit: DataFrame,
    day_tz: str = MARKET_TZ,
    price_col: str = "price_eur_mwh",
    zones: DataFrame | None = None,
) -> DataFrame:
    """Every zone's errors, warnings and skip flag.

    Checks union into (zone, level, message) rows: at most a handful of rows
    per zone, plus one per clock-change day. With ``zones`` (a zone dimension),
    listed zones without any price are errors too.
    """
    n = F.count(F.lit(1))

    def messages(df: DataFrame, level: str, message) -> DataFrame:
        return df.select("zone", F.lit(level).alias("level"), message.alias("message"))

    low = completeness(prices).where(~F.col("passes"))
    checks = [
        messages(
            low,
            "error",
            F.format_string(
                f"completeness %.1f%% < {MIN_COMPLETENESS_PCT}%%", F.col("completeness_pct")
            ),
        )
    ]
    for label, frame in (("Wind/solar", wind_solar), ("Load", load)):
        missing = gaps(frame).groupBy("zone").agg(n.alias("n"))
        checks.append(
            messages(missing, "warning", F.format_string(f"{label}: %d missing hours", F.col("n")))
        )
    dst = dst_day_errors(prices, day_tz)
    checks.append(
        messages(
            dst,
            "warning",
            F.format_string(
                "DST %s (%s): got %dh, expected %dh",
                "type", F.col("date").cast("string"), "actual", "hours",
            ),
        )
    )
    oor = prices.where(out_of_range(price_col)).groupBy("zone").agg(n.alias("n"))
    checks.append(
        messages(oor, "warning", F.format_string("%d prices out of range", F.col("n")))
    )
    spikes = (
        detect_outliers(prices, price_col)
        .where("is_outlier")
        .groupBy("zone")
        .agg(n.alias("n"))
        .where(F.col("n") > MAX_OUTLIERS)
    )
    checks.append(messages(spikes, "warning", F.format_string("%d price outliers", F.col("n"))))
    heavy = imputation_gate(prices, audit).where("warns")
    checks.append(
        messages(
            heavy,
            "warning",
            F.format_string("%.1f%% of hours were forward-filled", F.col("imputed_pct")),
        )
    )
    priced = prices.select("zone").distinct()
    everyone = priced
    if zones is not None:
        unpriced = zones.select("zone").distinct().join(priced, "zone", "left_anti")
        checks.append(
            messages(unpriced, "error", F.format_string("No price data for %s", "zone"))
        )
        everyone = priced.unionByName(unpriced)
    found = reduce(DataFrame.unionByName, checks)

    def listed(level: str):
        return F.sort_array(F.collect_list(F.when(F.col("level") == level, F.col("message"))))

    rolled = found.groupBy("zone").agg(
        listed("error").alias("errors"), listed("warning").alias("warnings")
    )
    empty = F.array().cast("array<string>")
    return (
        everyone.join(rolled, "zone", "left")
        .withColumn("errors", F.coalesce("errors", empty))
        .withColumn("warnings", F.coalesce("warnings", empty))
        .withColumn("skip", F.size("errors") > 0)
    )


def passing_zones(df: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows of zones without quality errors."""
    return attach(df, quality.where("skip").select("zone"), how="left_anti")
