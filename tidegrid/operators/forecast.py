"""Splits, learners, scoring and walk-forward forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidegrid.functions.stats import mae, pearson, rmse, smape
from tidegrid.functions.time import MARKET_TZ, local_date, local_hour
from tidegrid.operators.blocks import attach, with_position
from tidegrid.session import staged, with_checkpoint_dir

# Boosted-tree settings.
GBT_PARAMS = {
    "maxDepth": 6,
    "maxIter": 200,
    "stepSize": 0.1,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
#: Zones enter trees as numbers below this; more zones don't change the splits of other features.
ZONE_NUMBERS = 1 << 20
MIN_HOUR_ROWS = 10
MIN_TRAIN_ROWS = 48


def temporal_split(
    df: DataFrame, share: float = 0.7, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """``is_train``: true on the first ``floor(share·n)`` rows of each zone."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return (
        attach(with_position(df, by, name="_row"), sizes, by)
        .withColumn("is_train", F.col("_row") < F.floor(F.col("_n") * F.lit(float(share))))
        .drop("_row", "_n")
    )


# ------------------------------------------------------------- boosted trees


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def fit_gbt(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    params: dict | None = None,
    zone_feature: bool = True,
) -> PipelineModel:
    """One distributed boosted-tree model over all zones.

    The zone enters as a number, a hash of its name, so a single fit replaces
    one fit per zone and parallelises over rows rather than over zones; no list
    of zones is kept and unknown zones can be scored. The training rows are
    written once: the several hundred jobs of a fit read that table, not the
    feature plan, and a lost executor re-reads files. Every table is treated
    alike, whatever its size.
    """
    with_checkpoint_dir(df.sparkSession)
    inputs = list(features)
    wanted = _numeric(df, [*features, target]).select(
        *(["zone"] if zone_feature else []), *features, target
    )
    rows = staged(wanted, "training")
    stages = []
    if zone_feature:
        number = f"CAST(pmod(xxhash64(zone), {ZONE_NUMBERS}) AS DOUBLE)"
        stages.append(SQLTransformer(statement=f"SELECT *, {number} AS _zone_no FROM __THIS__"))
        inputs.append("_zone_no")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    settings = {**GBT_PARAMS, **(params or {})}
    stages.append(
        GBTRegressor(
            featuresCol="_features", labelCol=target, predictionCol="predicted_price", **settings
        )
    )
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``predicted_price``."""
    scored = model.transform(_numeric(df, features))
    return scored.select(*df.columns, "predicted_price")


def importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Impurity-gain importance per feature, largest first (one row per feature)."""
    weights = model.stages[-1].featureImportances.toArray()
    names = [*features, *(["zone"] if len(weights) > len(features) else [])]
    rows = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance"))
          for n, v in zip(names, weights)]
    )
    one = df.sparkSession.range(1).select(F.explode(rows).alias("_r")).select("_r.*")
    return one.orderBy(F.desc("importance"), "feature")


def fit_gbt_per_hour(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    params: dict | None = None,
    day_tz: str = MARKET_TZ,
) -> dict[int, PipelineModel]:
    """One model per delivery hour with at least ten training rows.

    At most 24 fits, each a distributed job over all zones' rows of that hour.
    """
    rows = df.withColumn("_hour", local_hour("ts_utc", day_tz))
    counts = rows.groupBy("_hour").count().where(F.col("count") >= MIN_HOUR_ROWS)
    hours = sorted(r["_hour"] for r in counts.collect())  # ≤ 24 rows
    return {
        h: fit_gbt(rows.where(F.col("_hour") == h).drop("_hour"), target, features, params)
        for h in hours
    }


def score_per_hour(
    models: dict[int, PipelineModel],
    df: DataFrame,
    features: Sequence[str],
    day_tz: str = MARKET_TZ,
) -> DataFrame:
    """Each row scored by its hour's model; hours without a model predict 0."""
    hour = local_hour("ts_utc", day_tz)
    missing = df.where(~hour.isin(*models)) if models else df
    out = missing.withColumn("predicted_price", F.lit(0.0))
    for h, model in models.items():
        out = out.unionByName(score(model, df.where(hour == h), features))
    return out


def importance_per_hour(
    models: dict[int, PipelineModel], df: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Feature importance averaged over the hour models, largest first."""
    parts = [importance(m, df, features) for m in models.values()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return (
        stacked.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


# ---------------------------------------------- linear learner by Gram sums


def _moments(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """One row per key with the packed upper triangle of the Gram matrix of
    [1, features…, target]: the sums of all products x_i·x_j, i ≤ j.

    Incomplete rows add nothing, but a key with only such rows still appears
    (with NULL sums).
    """
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in (*features, target))
    terms = [f"_x{i}" for i in range(len(features) + 2)]
    values = ["1D", *[f"CAST(`{c}` AS DOUBLE)" for c in (*features, target)]]
    rows = df.selectExpr(
        *keys, *[f"CASE WHEN {whole} THEN {v} END AS {t}" for v, t in zip(values, terms)]
    )
    sums = [
        f"sum({terms[i]} * {terms[j]})" for i in range(len(terms)) for j in range(i, len(terms))
    ]
    return rows.groupBy(*keys).agg(*[F.expr(f"{e} AS m{n}") for n, e in enumerate(sums)])


def _solve(packed: np.ndarray, width: int, l2: float) -> np.ndarray:
    """Ridge coefficients [intercept, features…] from packed Gram sums.

    Features are standardised with the window's own mean and deviation; a
    feature that is constant in the window gets coefficient 0. Raw sums carry a
    rounding error of about n·eps·level², so a variance below some times that
    counts as none.
    """
    gram = np.zeros((width, width))
    upper = np.triu_indices(width)
    gram[upper] = packed
    gram = gram + np.triu(gram, 1).T
    n, sums = gram[0, 0], gram[0, 1:]
    centred = gram[1:, 1:] - np.outer(sums, sums) / n
    variance = np.clip(np.diag(centred)[:-1] / n, 0, None)
    noise = 64 * max(n, 64.0) * np.finfo(float).eps * (sums[:-1] / n) ** 2
    live = variance > noise + 1e-18
    sd = np.sqrt(variance)
    beta = np.zeros(width - 2)
    if live.any():
        s = sd[live]
        a = centred[:-1, :-1][np.ix_(live, live)] / np.outer(s, s)
        b = centred[:-1, -1][live] / s
        beta[live] = np.linalg.lstsq(a + l2 * np.eye(len(s)), b, rcond=None)[0] / s
    intercept = (sums[-1] - beta @ sums[:-1]) / n
    return np.concatenate([[intercept], beta])


def ridge_coefficients(
    moments: DataFrame, keys: Sequence[str], n_features: int, l2: float = 1.0
) -> DataFrame:
    """Solve one small system per row of Gram sums; adds ``coefficients``."""
    width = n_features + 2
    cells = [f"m{i}" for i in range(width * (width + 1) // 2)]
    packed = moments.select(*keys, F.array(*cells).alias("_packed"))
    schema = packed.select(*keys).schema.add("coefficients", ArrayType(DoubleType()))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            out["coefficients"] = [
                _solve(np.asarray(p, dtype=float), width, l2) for p in batch["_packed"]
            ]
            yield out

    return packed.mapInPandas(solve, schema)


def linear_prediction(features: Sequence[str], coefficients: str = "coefficients") -> Column:
    """Intercept plus dot product, as native column arithmetic."""
    products = [
        f"{coefficients}[{i + 1}] * CAST(`{c}` AS DOUBLE)" for i, c in enumerate(features)
    ]
    return F.expr(" + ".join([f"{coefficients}[0]", *products]))


def fit_ridge_per_hour(
    train: DataFrame,
    target: str,
    features: Sequence[str],
    l2: float = 1.0,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """One linear model per zone and local hour (hours with < 10 rows skipped)."""
    keys = [*by, "hour"]
    rows = train.withColumn("hour", local_hour("ts_utc", day_tz))
    moments = _moments(rows, target, features, keys).where(F.col("m0") >= MIN_HOUR_ROWS)
    return ridge_coefficients(moments, keys, len(features), l2)


def predict_per_hour(
    models: DataFrame,
    df: DataFrame,
    features: Sequence[str],
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """``predicted_price`` from the hour's model; no model → 0, a missing
    feature → NULL."""
    rows = df.withColumn("hour", local_hour("ts_utc", day_tz))
    return (
        rows.join(models, [*by, "hour"], "left")
        .withColumn(
            "predicted_price",
            F.when(F.col("coefficients").isNull(), 0.0).otherwise(linear_prediction(features)),
        )
        .drop("coefficients", "hour")
    )


def walk_forward(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    window_days: int = 56,
    min_rows: int = MIN_TRAIN_ROWS,
    l2: float = 1.0,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
    folds: DataFrame | None = None,
    per_hour: bool = False,
) -> DataFrame:
    """Refit per zone and day on the preceding ``window_days`` days.

    Instead of rescanning a window per fold, each day's Gram sums are computed
    once (map-side combined) and added up over the preceding days by a range
    frame on the day number; one small ridge system per (zone, day) remains.
    ``df`` is read twice (training and scoring), so give it a stored matrix.
    ``folds`` (…, fold_day) restricts the scored days, e.g. to sampled ones.
    ``per_hour`` fits one model for each local hour of a fold, from at least ten
    rows; rows of an hour without a model are predicted 0 where their fold has
    ``min_rows`` rows, and the spine then has 24 rows a day.
    Returns ``by…, ts_utc, local_date, predicted_price, actual_price``.
    """
    rows = df.withColumn("local_date", local_date("ts_utc", day_tz))
    rows = rows.withColumn("_day_no", F.unix_date("local_date"))

    def models_of(frame: DataFrame, group: list[str], least: int) -> DataFrame:
        daily = _moments(frame, target, features, [*group, "_day_no"])
        cells = [c for c in daily.columns if c.startswith("m") and c[1:].isdigit()]
        series = f"PARTITION BY {', '.join(group)}"
        if folds is None:
            first = f"min(_day_no) OVER (PARTITION BY {', '.join(by)})"
            spine = daily.withColumn("_scored", F.expr(f"_day_no >= {first} + {window_days}"))
        else:
            wanted = folds.select(
                *by, F.unix_date("fold_day").alias("_day_no"), F.lit(True).alias("_scored")
            ).distinct()
            if per_hour and "_hour" in group:
                hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
                wanted = wanted.withColumn("_hour", hours)
            spine = daily.join(wanted, [*group, "_day_no"], "full_outer")
        past = f"{series} ORDER BY _day_no RANGE BETWEEN {window_days} PRECEDING AND 1 PRECEDING"
        windowed = (
            spine.selectExpr(
                *group, "_day_no", "_scored", *[f"sum({c}) OVER ({past}) AS {c}" for c in cells]
            )
            .where(F.col("_scored") & (F.col("m0") >= least))
            .drop("_scored")
        )
        return ridge_coefficients(windowed, [*group, "_day_no"], len(features), l2)

    prediction = linear_prediction(features)
    if per_hour:
        rows = rows.withColumn("_hour", local_hour("ts_utc", day_tz))
        usable = models_of(rows, list(by), min_rows).select(*by, "_day_no")
        hourly = models_of(rows, [*by, "_hour"], MIN_HOUR_ROWS)
        scored = rows.join(usable, [*by, "_day_no"]).join(
            hourly, [*by, "_hour", "_day_no"], "left"
        )
        prediction = F.when(F.col("coefficients").isNull(), 0.0).otherwise(prediction)
    else:
        scored = rows.join(models_of(rows, list(by), min_rows), [*by, "_day_no"])
    return scored.select(
        *by,
        "ts_utc",
        "local_date",
        prediction.alias("predicted_price"),
        F.col(target).alias("actual_price"),
    )


# -------------------------------------------------------------------- scoring


def evaluate(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """MAE, RMSE, sMAPE and sample count per group (all rows when empty)."""
    a, p = F.col(actual), F.col(predicted)
    both = df.where(a.isNotNull() & p.isNotNull())
    return both.groupBy(*by).agg(
        mae(a, p).alias("mae"),
        rmse(a, p).alias("rmse"),
        smape(a, p).alias("smape"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def evaluation_report(
    df: DataFrame,
    actual: str,
    predicted: str,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Overall metrics (``hour`` NULL) and metrics per local hour, stacked."""
    overall = evaluate(df, actual, predicted, by).withColumn("hour", F.lit(None).cast("int"))
    hourly = evaluate(
        df.withColumn("hour", local_hour("ts_utc", day_tz)), actual, predicted, [*by, "hour"]
    )
    return overall.unionByName(hourly)


def rank_correlation(
    df: DataFrame,
    actual: str,
    predicted: str,
    day_tz: str = MARKET_TZ,
    min_rows: int = 12,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """Mean daily Spearman correlation (average ranks; days under 12 rows and
    constant days skipped). Groups are single days, so windows stay small."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn(
        "_day", local_date("ts_utc", day_tz)
    )
    keys = [*by, "_day"]

    def average_rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy(*keys).orderBy(c))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return first + (ties - 1) / 2

    ranked = rows.withColumn("_ra", average_rank(actual)).withColumn(
        "_rp", average_rank(predicted)
    )
    daily = ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= min_rows, pearson(F.col("_ra"), F.col("_rp"))).alias("_r")
    )
    return daily.groupBy(*by).agg(
        F.avg("_r").alias("corr_f"), F.count("_r").alias("n_days")
    )


def skill(
    df: DataFrame, actual: str, predicted: str, baseline: str, by: Sequence[str] = ("zone",)
) -> DataFrame:
    """Model against baseline on the rows where both exist, with improvement %."""
    rows = df.where(
        F.col(actual).isNotNull() & F.col(predicted).isNotNull() & F.col(baseline).isNotNull()
    )
    a, p, b = F.col(actual), F.col(predicted), F.col(baseline)
    out = rows.groupBy(*by).agg(
        *[
            f(a, c).alias(f"{name}_{side}")
            for name, f in (("mae", mae), ("rmse", rmse), ("smape", smape))
            for side, c in (("model", p), ("baseline", b))
        ]
    )
    for name in ("mae", "rmse", "smape"):
        base, model = F.col(f"{name}_baseline"), F.col(f"{name}_model")
        out = out.withColumn(
            f"{name}_improvement_pct", (base - model) / F.nullif(base, F.lit(0.0)) * 100
        )
    return out


def hourly_winner(
    df: DataFrame,
    actual: str,
    single: str,
    per_hour: str,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
) -> DataFrame:
    """MAE by hour of two forecasts and which is lower."""
    a = F.col(actual)
    rows = df.where(a.isNotNull() & F.col(single).isNotNull() & F.col(per_hour).isNotNull())
    return (
        rows.groupBy(*by, local_hour("ts_utc", day_tz).alias("hour"))
        .agg(
            mae(a, F.col(single)).alias("mae_single"),
            mae(a, F.col(per_hour)).alias("mae_per_hour"),
        )
        .withColumn(
            "winner",
            F.when(F.col("mae_single") < F.col("mae_per_hour"), "Single").otherwise("Per-Hour"),
        )
    )
