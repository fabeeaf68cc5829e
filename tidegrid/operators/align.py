"""Deduplication, hourly grids, alignment and multi-source reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.time import hour_no, hour_ts
from tidegrid.operators.blocks import BLOCK, attach

KEYS = ("zone", "ts_utc")


def dedup(df: DataFrame, order: str, keep: str = "first", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: the first or last by the ingest sequence ``order``.

    A min/max-by aggregate, so copies of a hot key shrink before the shuffle.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def align_to(df: DataFrame, ref: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``df`` whose key also occurs in ``ref``."""
    return df.join(ref.select(*keys), list(keys), "left_semi")


def left_align(base: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All rows of ``base`` with the columns of ``other`` where present."""
    return base.join(other, list(keys), "left")


def inner_align(first: DataFrame, *others: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose key occurs in every input."""
    out = first
    for other in others:
        out = out.join(other, list(keys))
    return out


def key_difference(df: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other``."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def concat(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns missing in one become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def hour_span(df: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """First and last stored hour number of each series."""
    h = hour_no("ts_utc")
    return df.groupBy(*by).agg(F.min(h).alias("first_hour"), F.max(h).alias("last_hour"))


def hour_skeleton(df: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Every hour between the first and last stored hour of each series.

    Days are exploded and spread over tasks before their hours are, so neither
    a long series nor a single task has to produce the whole grid.
    """
    first_day, last_day = F.floor(F.col("first_hour") / 24), F.floor(F.col("last_hour") / 24)
    return (
        hour_span(df, by)
        .withColumn("_day", F.explode(F.sequence(first_day, last_day)))
        .repartition(*by, "_day")
        .withColumn("hour", F.explode(F.sequence(F.col("_day") * 24, F.col("_day") * 24 + 23)))
        .where(F.col("hour").between(F.col("first_hour"), F.col("last_hour")))
        .select(*by, "hour")
    )


def to_grid(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("zone",), agg: str = "avg"
) -> DataFrame:
    """Complete hourly grid: sub-hourly rows aggregated, missing hours NULL.

    The empty grid rows join the data by union, so one aggregation both
    resamples and fills in the missing hours. ``agg`` is ``avg`` or ``first``
    (first non-null value in the hour).
    """
    if agg not in ("avg", "first"):
        raise ValueError("agg must be 'avg' or 'first'")
    data = df.select(*by, hour_no("ts_utc").alias("hour"), "ts_utc", *cols)
    blank = hour_skeleton(df, by)
    rows = data.unionByName(blank, allowMissingColumns=True)

    def one(c: str):
        if agg == "avg":
            return F.avg(c).alias(c)
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts_utc"))).alias(c)

    return (
        rows.groupBy(*by, "hour")
        .agg(*[one(c) for c in cols])
        .select(*by, hour_ts("hour").alias("ts_utc"), *cols)
    )


def merged_hours(
    frames: dict[str, tuple[DataFrame, Sequence[str]]], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Several series merged by hour in a single aggregation.

    ``frames`` maps a label to (frame, columns). Sub-hourly rows are averaged.
    Adds ``has_<label>``, true on hours where that frame has a row. Stacking
    the frames and grouping once replaces one join per series.
    """
    stacked = None
    for label, (frame, cols) in frames.items():
        part = frame.select(
            *by, hour_no("ts_utc").alias("hour"), *cols, F.lit(1).alias(f"has_{label}")
        )
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    values = [c for _, cols in frames.values() for c in cols]
    return (
        stacked.groupBy(*by, "hour")
        .agg(
            *[F.avg(c).alias(c) for c in values],
            *[F.max(f"has_{label}").isNotNull().alias(f"has_{label}") for label in frames],
        )
        .withColumn("ts_utc", hour_ts("hour"))
        .drop("hour")
    )


def gap_intervals(df: DataFrame, by: Sequence[str] = ("zone",), block: int = BLOCK) -> DataFrame:
    """Runs of missing hours between stored ones: ``by…, start, end, n_hours`` (end inclusive).

    Each hour looks at its successor inside a block; the ends of blocks look at
    the next block that has rows, on a table of one row per block. A hole costs
    one interval however long it is, and no grid is made.
    """
    hours = df.select(*by, hour_no("ts_utc").alias("_hour")).withColumn("_block", F.floor(F.col("_hour") / block))
    inside = Window.partitionBy(*by, "_block").orderBy("_hour")
    within = hours.select(*by, F.col("_hour").alias("_from"), F.lead("_hour").over(inside).alias("_to"))
    ends = hours.groupBy(*by, "_block").agg(F.min("_hour").alias("_lo"), F.max("_hour").alias("_from"))
    following = Window.partitionBy(*by).orderBy("_block")
    between = ends.select(*by, "_from", F.lead("_lo").over(following).alias("_to"))
    holes = within.unionByName(between).where(F.col("_to") - F.col("_from") > 1)
    return holes.select(
        *by, hour_ts(F.col("_from") + 1).alias("start"), hour_ts(F.col("_to") - 1).alias("end"),
        (F.col("_to") - F.col("_from") - 1).alias("n_hours"),
    )


def gaps(df: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Hours missing between the first and last stored hour of each series."""
    hours = F.sequence(hour_no("start"), hour_no("end"))
    missing = gap_intervals(df, by).select(*by, F.explode(hours).alias("hour"))
    return missing.select(*by, hour_ts("hour").alias("ts_utc"))


def _in_order(df: DataFrame, order: str | None) -> DataFrame:
    """``df`` with ``_order``: the ingest order column, else the order of reading."""
    return df.withColumn(
        "_order", F.monotonically_increasing_id() if order is None else F.col(order)
    )


def _per_source(
    df: DataFrame, col: str, sources: Sequence[str], keys: Sequence[str], order: str | None
) -> DataFrame:
    """One value column per source, of repeated rows the first; a map-side-combined
    fixed pivot."""

    def first(s: str):
        mine = F.col("source") == s
        return F.min_by(F.when(mine, F.col(col)), F.when(mine, F.col("_order"))).alias(s)

    return _in_order(df, order).groupBy(*keys).agg(
        *[first(s) for s in sources],
        *[F.max(F.when(F.col("source") == s, F.lit(1))).alias(f"_row_{s}") for s in sources],
    )


def compare_sources(
    df: DataFrame,
    col: str,
    sources: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str | None = None,
) -> DataFrame:
    """Outer alignment of all sources with every pairwise difference.

    Of rows that repeat a source and key the first counts, by ``order`` if
    given, else as read.
    """
    wide = _per_source(df, col, sources, keys, order).drop(*[f"_row_{s}" for s in sources])
    for a, b in combinations(sources, 2):
        wide = wide.withColumn(f"diff_{a}_{b}", F.col(a) - F.col(b))
    return wide


def reconcile(
    df: DataFrame,
    col: str,
    priority: Sequence[str],
    keys: Sequence[str] = KEYS,
    extend: bool = False,
    by: Sequence[str] = ("zone",),
    order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Primary source with its NULLs filled from the next sources in turn.

    Of rows that repeat a source and key the first counts, as in
    ``compare_sources``.

    The primary of a series is its first source with any row. By default hours
    absent from the primary are not added; ``extend=True`` keeps the union.
    Returns the filled rows with their ``provenance`` and a report
    ``by…, primary_source, provenance, hours``.
    """
    primary = _chosen_source(df, priority, by).withColumnRenamed("source", "primary_source")
    wide = attach(_per_source(df, col, priority, keys, order), primary, by)

    def of(source_prefix: str, otherwise):
        out = otherwise
        for s in reversed(priority):
            out = F.when(F.col("primary_source") == s, F.col(f"{source_prefix}{s}")).otherwise(out)
        return out

    own = of("", F.lit(None).cast("double"))
    if not extend:
        wide = wide.where(of("_row_", F.lit(None).cast("int")).isNotNull())
    fill = F.coalesce(own, *[F.col(s) for s in priority])
    source = F.when(own.isNotNull(), F.col("primary_source"))
    for s in priority:
        source = F.coalesce(source, F.when(F.col(s).isNotNull(), F.lit(s)))
    filled = wide.select(
        *keys, fill.alias(col), F.coalesce(source, F.lit("gap")).alias("provenance"),
        "primary_source",
    )
    report = filled.groupBy(*by, "primary_source", "provenance").agg(
        F.count(F.lit(1)).alias("hours")
    )
    return filled.drop("primary_source"), report


def _priority_rank(priority: Sequence[str]):
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(priority))):
        rank = F.when(F.col("source") == s, F.lit(i)).otherwise(rank)
    return rank


def _chosen_source(df: DataFrame, priority: Sequence[str], by: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(F.min(_priority_rank(priority)).alias("_rank"))
        .where(F.col("_rank").isNotNull())
        .select(
            *by,
            F.element_at(F.array(*[F.lit(s) for s in priority]), F.col("_rank") + 1).alias(
                "source"
            ),
        )
    )


def pick_source(
    df: DataFrame, priority: Sequence[str], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Rows of the best available source of each series."""
    return attach(df, _chosen_source(df, priority, by), [*by, "source"], "left_semi")


def zone_sources(df: DataFrame, zones: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Every known zone with its chosen source, or ``'none'``."""
    return zones.join(_chosen_source(df, priority, ("zone",)), "zone", "left").select(
        *zones.columns, F.coalesce("source", F.lit("none")).alias("source")
    )


def price_matrix(
    df: DataFrame, col: str, zones: Sequence[str], order: str | None = None
) -> DataFrame:
    """One column per zone; hours at which every zone is NULL are dropped. Of
    rows that repeat a zone and hour the first counts."""

    def first(z: str):
        mine = F.col("zone") == z
        return F.min_by(F.when(mine, F.col(col)), F.when(mine, F.col("_order"))).alias(z)

    wide = _in_order(df, order).groupBy("ts_utc").agg(*[first(z) for z in zones])
    return wide.where(F.coalesce(*[F.col(z) for z in zones]).isNotNull())


def matrix_nulls(matrix: DataFrame, zones: Sequence[str]) -> DataFrame:
    """Missing values per zone of a price matrix, as rows."""
    counts = matrix.agg(
        *[F.count_if(F.col(z).isNull()).alias(z) for z in zones]
    )
    return counts.unpivot([], list(zones), "zone", "n_missing")


def edge_prices(edges: DataFrame, prices: DataFrame, col: str = "price_eur_mwh") -> DataFrame:
    """Prices at both ends of each interconnector at the same hour."""
    left = prices.select(F.col("zone").alias("from_zone"), "ts_utc", F.col(col).alias("price_from"))
    right = prices.select(F.col("zone").alias("to_zone"), "ts_utc", F.col(col).alias("price_to"))
    return attach(left, edges, ["from_zone"]).join(right, ["to_zone", "ts_utc"])


def edge_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Interconnectors with the display labels of both ends."""
    a = labels.select(F.col("zone").alias("from_zone"), F.col("label").alias("from_label"))
    b = labels.select(F.col("zone").alias("to_zone"), F.col("label").alias("to_label"))
    return edges.join(a, "from_zone", "left").join(b, "to_zone", "left")


def training_rows(
    df: DataFrame, day: str, window_days: int, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Walk-forward membership: each row once per fold it trains.

    A row of day ``d`` trains the folds ``d+1 … d+window_days``. Fold windows are
    cut on buckets of ``window_days`` days, two or less each, and the rows meet them
    by (series, bucket), once and without copies; the range is checked inside a
    bucket. The result has ``window_days`` rows for each hour: it is a report, and
    models take the daily sums of ``forecast.walk_forward`` instead.
    """
    bucket = lambda date: F.floor(F.unix_date(date) / window_days)
    folds = fold_days(df, day, window_days, by)
    first = F.date_sub("fold_day", window_days)
    windows = folds.withColumn(
        "_bucket", F.explode(F.sequence(bucket(first), bucket(F.date_sub("fold_day", 1))))
    )
    met = df.withColumn("_bucket", bucket(F.col(day))).join(windows, [*by, "_bucket"])
    inside = (F.col(day) >= first) & (F.col(day) < F.col("fold_day"))
    return met.where(inside).select(*df.columns, "fold_day")


def fold_days(
    df: DataFrame, day: str, window_days: int, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Test days of each series: those at least ``window_days`` after its first."""
    days = df.groupBy(*by, day).agg(F.lit(1).alias("_x")).drop("_x")
    first = days.groupBy(*by).agg(F.min(day).alias("_first"))
    return (
        days.join(first, list(by))
        .where(F.col(day) >= F.date_add("_first", window_days))
        .select(*by, F.col(day).alias("fold_day"))
    )
