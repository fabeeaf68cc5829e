"""Profiles, correlations, distributions and rankings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.stats import pair_count, pearson, share_pct
from tidegrid.functions.time import MARKET_TZ, hour_no, local_date, local_hour, local_month, week_end
from tidegrid.operators.align import edge_prices
from tidegrid.operators.blocks import BLOCK, attach, hours_back, trailing
from tidegrid.operators.quantiles import quantile_columns
from tidegrid.operators.screen import calendar_parts, clip_to_quantiles
from tidegrid.session import staged

PRICE = "price_eur_mwh"


def profile_by(
    df: DataFrame,
    part: str,
    cols: Sequence[str] = (PRICE,),
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Mean of each column by local ``hour``, ``weekday`` or ``month``."""
    return (
        calendar_parts(df, day_tz)
        .groupBy(*by, part)
        .agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    )


def box_stats(
    df: DataFrame, col: str = PRICE, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Quartiles and whiskers by local hour; a whisker is the most extreme
    value within 1.5 interquartile ranges of its box edge."""
    rows = df.where(F.col(col).isNotNull()).select(
        *by, local_hour("ts_utc", day_tz).alias("hour"), col
    )
    keys = [*by, "hour"]
    box = quantile_columns(rows, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(col)
    return (
        rows.join(box, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_lo"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_hi"),
        )
    )


def resample_mean(
    df: DataFrame,
    freq: str,
    col: str = PRICE,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Mean per local day, or per week labelled by its closing Sunday."""
    day = local_date("ts_utc", day_tz)
    period = {"day": day, "week": week_end(day)}[freq]
    return df.groupBy(*by, period.alias("period")).agg(F.avg(col).alias("mean_value"))


def describe(df: DataFrame, col: str, by: Sequence[str] = ("zone",)) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum."""
    quartiles = quantile_columns(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    basics = df.groupBy(*by).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    if not by:
        one = F.lit(0)
        joined = basics.withColumn("_k", one).join(quartiles.withColumn("_k", one), "_k", "left")
        joined = joined.drop("_k")
    else:
        joined = basics.join(quartiles, list(by), "left")
    return joined.select(*by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def source_difference(
    compared: DataFrame, diff: str, tolerance: float = 0.01, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Describe a source difference over shared hours and count matches."""
    shared = compared.where(F.col(diff).isNotNull())
    matches = shared.groupBy(*by).agg(
        F.count_if(F.abs(diff) < tolerance).alias("n_match"),
        (share_pct(F.abs(diff) < tolerance) / 100).alias("match_share"),
    )
    return describe(shared, diff, by).join(matches, list(by))


def correlation_with(
    df: DataFrame, target: str, cols: Sequence[str], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Correlation of each column with ``target``, as (…, column, r) rows."""
    wide = df.groupBy(*by).agg(*[pearson(F.col(target), F.col(c)).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "r")


def correlation_matrix(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Every ordered pair of columns with its correlation, from one aggregate."""
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(pearson(F.col(a), F.col(b)).alias(f"r_{a}_{b}"))
            for x, y in {(a, b), (b, a)}:
                pairs.append((x, y, f"r_{a}_{b}"))
    wide = df.groupBy(*by).agg(*aggs)
    cells = F.array(
        *[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(n).alias("r"))
          for x, y, n in pairs]
    )
    return wide.select(*by, F.explode(cells).alias("_c")).select(
        *by, F.col("_c.a").alias("column_a"), F.col("_c.b").alias("column_b"), "_c.r"
    )


def lagged_cross_correlation(
    edges: DataFrame,
    prices: DataFrame,
    col: str = PRICE,
    max_lag: int = 3,
    min_pairs: int = 100,
) -> DataFrame:
    """Correlation of each zone with every neighbour's price 0…n hours earlier.

    Edges count in both directions. The neighbour's lags come from one blocked
    window, so only one hourly join per direction is needed.
    """
    lags = list(range(max_lag + 1))
    shifted = trailing(
        prices.select("zone", "ts_utc", col),
        max(max_lag, 1),
        lambda w: {f"_l{k}": hours_back(col, k, w) for k in lags},
    )
    ends = edges.select(F.col("from_zone").alias("zone"), F.col("to_zone").alias("neighbour"))
    both_ways = ends.union(
        ends.select(F.col("neighbour").alias("zone"), F.col("zone").alias("neighbour"))
    ).distinct()
    own = prices.select("zone", "ts_utc", F.col(col).alias("_own"))
    other = shifted.select(
        F.col("zone").alias("neighbour"), "ts_utc", *[f"_l{k}" for k in lags]
    )
    paired = attach(own, both_ways).join(other, ["neighbour", "ts_utc"])
    aggs = []
    for k in lags:
        enough = pair_count(F.col("_own"), F.col(f"_l{k}")) > min_pairs
        aggs.append(F.when(enough, pearson(F.col("_own"), F.col(f"_l{k}"))).alias(f"lag_{k}h"))
    return paired.groupBy("zone", "neighbour").agg(*aggs)


def autocorrelation(
    prices: DataFrame, col: str = PRICE, max_lag: int = 72, by: Sequence[str] = ("zone",), block: int = BLOCK
) -> DataFrame:
    """Autocorrelation at lags 1…n.

    A block of hours, with the ``max_lag`` before it, becomes one array; a task
    multiplies it with itself shifted by every lag and sends one row per lag:
    counts, means and centred products, which add up over blocks. No row is
    copied per lag. Hours must be unique per series.
    """
    import pyarrow as pa

    hour = hour_no("ts_utc").cast("bigint")
    home = F.floor(hour / block)
    blocks = F.when(F.pmod(hour, F.lit(block)) >= block - max_lag, F.array(home, home + 1)).otherwise(F.array(home))
    rows = prices.where(F.col(col).isNotNull()).select(
        *by, hour.alias("_hour"), F.col(col).cast("double").alias("_x"), F.explode(blocks).alias("_block")
    )
    sums = ("_n", "_mx", "_my", "_xx", "_yy", "_xy")
    kinds = ", ".join(f"`{c}` {prices.schema[c].dataType.simpleString()}" for c in by)

    def products(table):
        at = table.column("_hour").to_numpy()
        start = int(table.column("_block")[0].as_py()) * block
        x = np.full(block + max_lag, np.nan)
        x[at - start + max_lag] = table.column("_x").to_numpy()
        own, out = x[max_lag:], []
        for lag in range(1, max_lag + 1):
            y = x[max_lag - lag : max_lag - lag + block]
            both = ~(np.isnan(own) | np.isnan(y))
            n = int(both.sum())
            if n:
                a, b = own[both], y[both]
                ma, mb = a.mean(), b.mean()
                a, b = a - ma, b - mb
                out.append((lag, n, ma, mb, a @ a, b @ b, a @ b))
        columns = list(zip(*out, strict=True)) or [()] * 7
        key = {c: table.column(c).take(pa.array([0] * len(out), pa.int64())) for c in by}
        types = [pa.int32(), pa.int64(), *[pa.float64()] * 5]
        values = {c: pa.array(v, t) for c, v, t in zip(("lag_hours", *sums), columns, types, strict=True)}
        return pa.table({**key, **values})

    parts = rows.groupBy(*by, "_block").applyInArrow(
        products, f"{kinds}, lag_hours int, _n long, " + ", ".join(f"{c} double" for c in sums[1:])
    )
    keys = [*by, "lag_hours"]
    of_lag = Window.partitionBy(*keys)  # one row per block
    mean = lambda c: F.sum(F.col("_n") * F.col(c)).over(of_lag) / F.sum("_n").over(of_lag)
    centred = parts.withColumn("_dx", F.col("_mx") - mean("_mx")).withColumn("_dy", F.col("_my") - mean("_my"))
    total = lambda c, a, b: F.sum(F.col(c) + F.col("_n") * F.col(a) * F.col(b))
    spread = F.sqrt(total("_xx", "_dx", "_dx")) * F.sqrt(total("_yy", "_dy", "_dy"))
    found = centred.groupBy(*keys).agg(
        F.when(F.sum("_n") > 1, total("_xy", "_dx", "_dy") / F.nullif(spread, F.lit(0.0))).alias("r")
    )
    # lags without a pair of hours stay, as NULL
    every = prices.select(*by).distinct().withColumn(
        "lag_hours", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))
    )
    return every.join(found, keys, "left").select(*keys, "r")


def adjacent_correlation(
    edges: DataFrame, prices: DataFrame, col: str = PRICE, min_hours: int = 100
) -> DataFrame:
    """Price correlation across each interconnector with enough shared hours."""
    a, b = F.col("price_from"), F.col("price_to")
    return (
        edge_prices(edges, prices, col)
        .groupBy("from_zone", "to_zone")
        .agg(pearson(a, b).alias("correlation"), pair_count(a, b).alias("n_hours"))
        .where(F.col("n_hours") > min_hours)
    )


def spread_stats(
    edges: DataFrame, prices: DataFrame, col: str = PRICE, tolerance: float = 0.01
) -> DataFrame:
    """Mean, deviation, positive share and identical share of each spread."""
    spread = F.col("price_from") - F.col("price_to")
    return (
        edge_prices(edges, prices, col)
        .withColumn("spread", spread)
        .where(F.col("spread").isNotNull())
        .groupBy("from_zone", "to_zone")
        .agg(
            F.count(F.lit(1)).alias("n_hours"),
            F.avg("spread").alias("mean_spread"),
            F.stddev_samp("spread").alias("std_spread"),
            share_pct(F.col("spread") > 0).alias("positive_pct"),
            share_pct(F.abs("spread") < tolerance).alias("identical_pct"),
        )
    )


def daily_spread(edges: DataFrame, prices: DataFrame, day_tz: str, col: str = PRICE) -> DataFrame:
    """Daily mean price spread per interconnector."""
    rows = edge_prices(edges, prices, col).withColumn(
        "spread", F.col("price_from") - F.col("price_to")
    )
    return resample_mean(rows, "day", "spread", day_tz, ("from_zone", "to_zone"))


def binned_curve(
    df: DataFrame, x: str, y: str, bins: int = 20, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Mean, median, deviation and count of ``y`` in equal-width, right-closed
    bins of ``x``; ``mid`` is the middle of the bin, whose first left edge lies
    0.1 % of the range below the minimum."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    span = rows.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.ceil((F.col(x) - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    bin_no = F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(bins))
    left = F.when(
        F.col("bin") == 1, F.col("_lo") - (F.col("_hi") - F.col("_lo")) * 0.001
    ).otherwise(F.col("_lo") + width * (F.col("bin") - 1))
    mid = (left + F.col("_lo") + width * F.col("bin")) / 2
    placed = attach(rows, span, by).withColumn("bin", bin_no)
    stats = placed.groupBy(*by, "bin").agg(
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )
    medians = quantile_columns(placed, y, {"median": 0.5}, [*by, "bin"])
    return (
        stats.withColumn("mid", mid)
        .drop("_lo", "_hi")
        .join(medians, [*by, "bin"])
        .select(*by, "bin", "mid", "mean", "median", "std", "n")
    )


def histogram(
    df: DataFrame, col: str, bins: int = 100, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; left-closed,
    with the maximum in the last bin. Empty bins are not listed."""
    rows = df.where(F.col(col).isNotNull()).select(*by, col)
    span = rows.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.floor((F.col(col) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) + 1
    bin_no = F.least(F.coalesce(place, F.lit(1)), F.lit(bins))
    return (
        attach(rows, span, by)
        .groupBy(*by, bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clipped_histogram(df: DataFrame, col: str = PRICE, bins: int = 100) -> DataFrame:
    """Histogram of prices clipped to their 0.1 % and 99.9 % quantiles."""
    return histogram(clip_to_quantiles(df, col), "clipped", bins)


def with_tail_segment(
    df: DataFrame, col: str = PRICE, tail: float = 0.01, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``segment``: bottom (≤ low quantile), top (≥ high quantile) or middle."""
    cut = quantile_columns(df, col, {"_lo": tail, "_hi": 1 - tail}, by)
    segment = (
        F.when(F.col(col) <= F.col("_lo"), "bottom")
        .when(F.col(col) >= F.col("_hi"), "top")
        .when(F.col(col).isNotNull(), "middle")
    )
    return attach(df, cut, by).withColumn("segment", segment).drop("_lo", "_hi")


def tail_conditions(
    df: DataFrame, means: Sequence[str], col: str = PRICE, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Hours and mean conditions in the bottom 1 %, middle and top 1 %."""
    rows = with_tail_segment(df, col, by=by).where(F.col("segment").isNotNull())
    return rows.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("n_hours"), *[F.avg(c).alias(f"mean_{c}") for c in means]
    )


def tail_hours(
    df: DataFrame, col: str = PRICE, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """How often each local hour falls into either price tail."""
    rows = with_tail_segment(df, col, by=by).where(F.col("segment").isin("bottom", "top"))
    return rows.groupBy(*by, "segment", local_hour("ts_utc", day_tz).alias("hour")).agg(
        F.count(F.lit(1)).alias("n_hours")
    )


def extreme_hours(
    df: DataFrame,
    k: int = 10,
    highest: bool = True,
    col: str = PRICE,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """The k highest or lowest hours of each zone; ties go to the earlier hour.

    The rank filter is pushed below the shuffle, so each task sends at most k
    rows per zone.
    """
    order = F.desc(col) if highest else F.asc(col)
    w = Window.partitionBy(*by).orderBy(order, "ts_utc")
    top = (
        df.where(F.col(col).isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
    return calendar_parts(top, day_tz).select(*by, "rank", "ts_utc", col, "hour", "weekday")


def hour_month_table(
    df: DataFrame, col: str = PRICE, day_tz: str = MARKET_TZ, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Mean by local hour (rows) and month (columns ``m1`` … ``m12``)."""
    month = local_month("ts_utc", day_tz)
    return df.groupBy(*by, local_hour("ts_utc", day_tz).alias("hour")).agg(
        *[F.avg(F.when(month == m, F.col(col))).alias(f"m{m}") for m in range(1, 13)]
    )


def zone_metrics(
    prices: DataFrame,
    zones: DataFrame,
    wind_solar: DataFrame | None = None,
    load: DataFrame | None = None,
    col: str = PRICE,
    default_cost: float = 50_000.0,
) -> DataFrame:
    """Price level, variability and data flags per zone with label and cost.

    ``zones`` is a dimension ``zone, label, entry_cost_eur``.
    """
    p = F.col(col)
    stats = prices.groupBy("zone").agg(
        F.avg(p).alias("mean_price"),
        F.stddev_samp(p).alias("std_price"),
        share_pct(p < 0).alias("neg_pct"),
        (F.max(p) - F.min(p)).alias("price_range"),
    )
    cv = F.when(F.col("mean_price") == 0, F.lit(0.0)).otherwise(
        F.col("std_price") / F.nullif(F.abs("mean_price"), F.lit(0.0))
    )
    out = stats.withColumn("cv_price", cv).join(zones, "zone", "left")
    out = out.withColumn("label", F.coalesce("label", "zone"))
    out = out.withColumn("entry_cost_eur", F.coalesce("entry_cost_eur", F.lit(default_cost)))
    for name, frame in (("has_wind_solar", wind_solar), ("has_load", load)):
        if frame is None:
            out = out.withColumn(name, F.lit(False))
            continue
        seen = frame.groupBy("zone").agg(F.lit(True).alias(name))
        out = out.join(seen, "zone", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


# Score weights of the attractiveness ranking.
WEIGHTS = {"cv_price": 0.35, "neg_pct": 0.25, "entry_cost_eur": 0.20, "data_score": 0.20}


def attractiveness(metrics: DataFrame) -> DataFrame:
    """Min–max normalised metrics (cost inverted; constant → 0.5) and the
    weighted score. The per-zone table is written once; one aggregation of it
    gives all extremes."""
    scored = (("cv_price", False), ("neg_pct", False), ("entry_cost_eur", True))
    table = staged(metrics, "zone-metrics")
    ends = table.agg(
        *[F.min(n).alias(f"_lo_{n}") for n, _ in scored],
        *[F.max(n).alias(f"_hi_{n}") for n, _ in scored],
    )
    out = table.join(F.broadcast(ends))  # one row
    for name, invert in scored:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        unit = (F.col(name) - lo) / F.nullif(hi - lo, F.lit(0.0))
        unit = F.lit(1.0) - unit if invert else unit
        out = out.withColumn(f"{name}_norm", F.coalesce(unit, F.lit(0.5)))
    out = out.drop(*ends.columns)
    flags = F.col("has_wind_solar").cast("double") + F.col("has_load").cast("double")
    out = out.withColumn("data_score", flags / 2)
    return out.withColumn(
        "attractiveness",
        F.col("cv_price_norm") * WEIGHTS["cv_price"]
        + F.col("neg_pct_norm") * WEIGHTS["neg_pct"]
        + F.col("entry_cost_eur_norm") * WEIGHTS["entry_cost_eur"]
        + F.col("data_score") * WEIGHTS["data_score"],
    )


def ranked(df: DataFrame, score: str, tie: str = "zone", ranges: int = 64) -> DataFrame:
    """Every row with its rank by score, best first; missing scores come last.

    Rows are dealt to ranges of (score, tie) and written with the range's number,
    numbered inside it, and lifted by the count of the ranges before: no task
    sees more than its range, however many zones there are.
    """
    order = (F.desc(score), F.asc(tie))
    dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    rows = staged(dealt, "ranked")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most ``ranges`` rows
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn("rank", (F.col("rank") + F.col("_before")).cast("int"))
        .drop("_range", "_before")
    )


def error_by_hour(
    df: DataFrame, actual: str, predicted: str, day_tz: str, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Mean absolute error by local delivery hour."""
    return df.groupBy(*by, local_hour("ts_utc", day_tz).alias("hour")).agg(
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae")
    )


def null_share(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("zone",)) -> DataFrame:
    """Percentage of NULLs per column, as (…, column, null_pct) rows."""
    wide = df.groupBy(*by).agg(*[share_pct(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "null_pct")


