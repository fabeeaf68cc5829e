"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here equal values are first counted, each group is cut into bins at
approximate quantiles, so that they hold about equal shares whatever the values,
and only the bins that hold a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.blocks import attach

BINS = 64


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """One row per group and probability: ``by…, prob_no, prob, quantile``
    with linear interpolation between the two neighbouring ranks."""
    keys = list(by) or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(0))
    counted = (
        d.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cuts = F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], 20 * BINS)
    span = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), cuts.alias("_cuts"))
    binned = (
        attach(counted, span, keys)
        .withColumn("_bin", F.expr("size(filter(_cuts, c -> c <= _v))"))
        .drop("_cuts")
    )

    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("prob_no"),
                F.lit(float(p)).alias("prob"),
                (F.lit(float(p)) * (F.col("_total") - 1)).alias("_rank"),
            )
            for i, p in enumerate(probs)
        ]
    )

    def hits(frame: DataFrame) -> DataFrame:
        """Pair rows covering ranks [_before, _after) with the ranks they hold."""
        low, high = F.floor("_q._rank"), F.ceil("_q._rank")
        return (
            frame.withColumn("_q", F.explode(wanted))
            .withColumn("_is_low", (low >= F.col("_before")) & (low < F.col("_after")))
            .withColumn("_is_high", (high >= F.col("_before")) & (high < F.col("_after")))
            .where(F.col("_is_low") | F.col("_is_high"))
        )

    bins = binned.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_n"), F.first("_total").alias("_total")
    )
    up_to = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.withColumn("_after", F.sum("_n").over(up_to)).withColumn(
        "_before", F.col("_after") - F.col("_n")
    )
    needed = hits(bins).select(*keys, "_bin", F.col("_before").alias("_base")).distinct()

    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = (
        binned.join(needed, [*keys, "_bin"])
        .withColumn("_after", F.col("_base") + F.sum("_n").over(in_bin))
        .withColumn("_before", F.col("_after") - F.col("_n"))
    )
    low, high = F.col("_low"), F.col("_high")
    found = (
        hits(ranked)
        .groupBy(*keys, F.col("_q.prob_no").alias("prob_no"), F.col("_q.prob").alias("prob"))
        .agg(
            F.max(F.when(F.col("_is_low"), F.col("_v"))).alias("_low"),
            F.max(F.when(F.col("_is_high"), F.col("_v"))).alias("_high"),
            F.max("_q._rank").alias("_rank"),
        )
        .withColumn("quantile", low + (high - low) * (F.col("_rank") - F.floor("_rank")))
    )
    return found.select(*by, "prob_no", "prob", "quantile")


def quantile_columns(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ("zone",)
) -> DataFrame:
    """The same quantiles as one named column each, one row per group."""
    names = list(probs)
    long = exact_quantiles(df, value, [probs[n] for n in names], by)
    picks = [
        F.max(F.when(F.col("prob_no") == i, F.col("quantile"))).alias(n)
        for i, n in enumerate(names)
    ]
    return long.groupBy(*by).agg(*picks)
