"""Windows over long series without one task per series.

A trailing frame of ``before`` hours never looks further back than that, so a
series can be cut into fixed-length blocks if each block also gets the last
``before`` hours of the block ahead of it. The window then partitions by
(series, block): a series holding a third of all rows still spreads over as
many tasks as it has blocks, and the results equal the uncut window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.time import hour_no

#: Parts that the rows of one series are dealt to when they meet a value of that series.
PARTS = 128
BLOCK = 2160  # 90 days of hours; the copied rows stay under 9 % for a 191-hour frame


def trailing(
    df: DataFrame,
    before: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    by: Sequence[str] = ("zone",),
    pos: str | None = None,
    block: int = BLOCK,
    moments: Sequence[tuple[str, int, int]] = (),
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` back.

    The window orders by the hour number, so RANGE frames count hours and need
    no rows for missing hours. With ``pos`` (a gapless row position) it orders
    by that and frames count rows. ``moments`` (column, start, end) prepares the
    frames whose count, mean and deviation ``frame_moments`` gives.
    """
    if block < before:
        raise ValueError("a block must be at least as long as the frame")
    at = F.col(pos) if pos else hour_no("ts_utc")
    d = df.withColumn("_pos", at.cast("bigint"))
    home = F.floor(F.col("_pos") / block)
    near_end = F.pmod(F.col("_pos"), F.lit(block)) >= block - before
    d = d.withColumn(
        "_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    w = Window.partitionBy(*by, "_block").orderBy("_pos")
    columns = sorted({c for c, _, _ in moments})
    for step in (_centres, _running_sums):
        d = d.withColumns({k: v for c in columns for k, v in step(c, w).items()})
    ends = sorted({(c, at) for c, start, end in moments for at in (start - 1, end)})
    d = d.withColumns({
        f"_till_{c}_{at}": F.last(f"_sums_{c}").over(w.rangeBetween(Window.unboundedPreceding, at)) for c, at in ends
    })
    made = build(w)
    kept = [F.col(c) for c in df.columns if c not in made]
    return (
        d.select(*kept, *[c.alias(n) for n, c in made.items()], "_pos", "_block")
        .where(F.col("_block") == F.floor(F.col("_pos") / block))
        .drop("_pos", "_block")
    )


def _centres(col: str, w: WindowSpec) -> dict[str, Column]:
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {f"_centre_{col}": F.coalesce(F.avg(col).over(whole), F.lit(0.0))}


def _running_sums(col: str, w: WindowSpec) -> dict[str, Column]:
    """Count and sum up to each row of a block, and sums of its distances from the block's mean and
    of their squares.

    Each summand is cut into a multiple of a power of two, whose sums are exact in a double, and a
    small rest, so that the difference of two running sums is as good as a sum over the frame.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(col).cast("double")
    v = x - F.col(f"_centre_{col}")

    def parts(x: Column, bits: int) -> list[Column]:
        scale = float(1 << bits)
        main = F.rint(x * scale) / scale
        return [F.coalesce(F.sum(part).over(upto), F.lit(0.0)) for part in (main, x - main)]

    m, m_rest = parts(x, 20)
    s, s_rest = parts(v, 20)
    q, q_rest = parts(v * v, 16)
    sums = F.struct(
        F.count(v).over(upto).alias("n"), m.alias("m"), m_rest.alias("m_rest"), s.alias("s"), s_rest.alias("s_rest"), q.alias("q"), q_rest.alias("q_rest")
    )
    return {f"_sums_{col}": sums}


def frame_moments(col: str, start: int, end: int) -> tuple[Column, Column, Column]:
    """(count, mean, sample deviation) of ``col`` over the frame from ``start`` to ``end``.

    The difference of two running sums: a row costs the same whatever the frame's length. The frame
    must be one of the ``moments`` of ``trailing``. A deviation that is noise of the squares is 0.
    """
    last, before = F.col(f"`_till_{col}_{end}`"), F.col(f"`_till_{col}_{start - 1}`")

    def total(name: str) -> Column:
        return F.coalesce(last[name], F.lit(0)) - F.coalesce(before[name], F.lit(0))

    n, s, q = total("n"), total("s") + total("s_rest"), total("q") + total("q_rest")
    some = F.nullif(n, F.lit(0).cast("bigint"))
    mean = (total("m") + total("m_rest")) / some
    left = q - s * s / some
    spread = F.when(left > q * 4e-15, left).otherwise(F.lit(0.0))
    return n, mean, F.when(n > 1, F.sqrt(spread / (n - 1)))


def hours_back(col: str, hours: int, w: WindowSpec) -> Column:
    """Value exactly ``hours`` earlier; NULL when that hour has no row."""
    return F.max(col).over(w.rangeBetween(-hours, -hours))


def attach(
    rows: DataFrame, values: DataFrame, by: Sequence[str] = ("zone",), how: str = "inner", parts: int = PARTS
) -> DataFrame:
    """Join hourly ``rows`` with ``values``, a table of few rows per series, on ``by``.

    A plain join would send all rows of a series to one task. Here a hash of the
    row's other columns deals a series to ``parts`` tasks, and only ``values``,
    one copy per part, is replicated; if it is small, Spark broadcasts it and no
    row moves at all. ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"values can't be attached by a {how} join")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in by]
    part = F.pmod(F.xxhash64(*others), F.lit(parts)).cast("int") if others else F.lit(0)
    copies = values.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_part", part).join(copies, [*by, "_part"], how).drop("_part")


def with_position(
    df: DataFrame, by: Sequence[str] = ("zone",), chunk_hours: int = 720, name: str = "pos"
) -> DataFrame:
    """Exact 0-based row position of every row in its series, by ``ts_utc``.

    Rows are numbered inside (series, month-sized chunk); the chunk's offset is
    a running total over the few chunk counts of the series. Timestamps must be
    unique per series.
    """
    keys = [*by, "_chunk"]
    d = df.withColumn("_chunk", F.floor(hour_no("ts_utc") / chunk_hours))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy("ts_utc")
    return (
        d.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_chunk", "_rn", "_offset")
    )


def trailing_rows(
    df: DataFrame,
    before: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    by: Sequence[str] = ("zone",),
    block: int = BLOCK,
    moments: Sequence[tuple[str, int, int]] = (),
) -> DataFrame:
    """``trailing`` for series with gaps: frames count rows, not hours."""
    numbered = with_position(df, by, name="_row")
    made = trailing(numbered, before, build, by, pos="_row", block=block, moments=moments)
    return made.drop("_row")


def running(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    day: str,
) -> DataFrame:
    """Running total and running peak of ``value`` along each series.

    Adds ``cumulative`` and ``peak``. Rows accumulate inside (series, day);
    day totals carry over through a window on one row per day.
    """
    keys = [*by, day]
    inside = (
        Window.partitionBy(*keys).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    )
    part = df.withColumn("_c", F.sum(value).over(inside)).withColumn(
        "_p", F.max("_c").over(inside)
    )
    days = part.groupBy(*keys).agg(F.sum(value).alias("_s"), F.max("_c").alias("_m"))
    carried = day_carry(days, by, day, "_s", "_m")
    return (
        part.join(carried.select(*keys, "offset", "earlier_peak"), keys)
        .withColumn("cumulative", F.col("offset") + F.col("_c"))
        .withColumn("peak", F.greatest("earlier_peak", F.col("offset") + F.col("_p")))
        .drop("_c", "_p", "offset", "earlier_peak")
    )


def day_carry(
    days: DataFrame, by: Sequence[str], day: str, total: str, max_prefix: str
) -> DataFrame:
    """Per day: the sum of all earlier days and the highest earlier level
    (NULL on the first day)."""
    earlier = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    with_offset = days.withColumn("offset", F.coalesce(F.sum(total).over(earlier), F.lit(0.0)))
    return with_offset.withColumn(
        "earlier_peak", F.max(F.col("offset") + F.col(max_prefix)).over(earlier)
    )
