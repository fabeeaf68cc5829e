"""Gradient-boosted trees for many models at once: one per zone, fold or hour.

Features are quantised inside each model's training rows. All models of a task grow together: on
every level of a tree one histogram over (model, node, feature, bin) gives the gradient sums that
choose all splits, so the number of array operations doesn't depend on the number of models. Spark
deals the models out: a fold's rows are bounded by its window, a zone's by the hours of its history
at one byte per feature. A single fit over all zones' rows is ``forecast.fit_gbt``.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import rmse
from tidegrid.functions.time import MARKET_TZ, hour_no, local_date, local_hour
from tidegrid.operators.align import fold_days
from tidegrid.operators.forecast import MIN_HOUR_ROWS, MIN_TRAIN_ROWS

#: Training rows of the models that grow together, and days of the folds that share a task.
BATCH_ROWS, BLOCK_DAYS = 60_000, 28
#: Gains nearer than this to the best count as equal; the first feature and bin wins.
TIE = 1e-9


@dataclass(frozen=True)
class Settings:
    """Size and randomness of a model; ``rows`` and ``columns`` are the shares a tree sees."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    l2: float = 1.0
    min_gain: float = 1e-6
    seed: int = 42


@dataclass
class Trees:
    """One model: trees as heaps of ``feature`` (-1 at leaves), ``threshold`` and ``value``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    splits: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Trees:
        with np.load(io.BytesIO(raw)) as z:
            return Trees(**{k: z[k] for k in z.files})


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sampled_rows(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Which rows a tree sees: by a hash of the row's key, whatever the order of rows."""
    salt = np.array([settings.seed * 1_000_003 + tree], np.uint64)
    return (_mix(key.astype(np.uint64) ^ _mix(salt)) >> np.uint64(11)) < settings.rows * 2.0**53


def sampled_columns(n: int, tree: int, settings: Settings) -> np.ndarray:
    """Which features a tree sees."""
    count = max(1, int(np.ceil(settings.columns * n)))
    order = np.random.default_rng([settings.seed, tree]).permutation(n)
    return np.sort(order[:count])


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of the bins of one feature, midway between values; missing values aside."""
    values = np.sort(x[~np.isnan(x)])
    distinct = np.unique(values)
    if len(distinct) <= 1:
        return np.zeros(0)
    if len(distinct) >= bins:
        at = np.arange(1, bins - 1) * len(values) // (bins - 1)
        below = np.unique(np.searchsorted(distinct, values[at], "left"))
        below = below[below > 0] - 1
    else:
        below = np.arange(len(distinct) - 1)
    return (distinct[below] + distinct[below + 1]) / 2


def codes_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers from 1; 0 is a missing value, which always goes to the lower side."""
    out = np.searchsorted(edges, x, "left") + 1
    return np.where(np.isnan(x), 0, out)


def train(
    x: np.ndarray, y: np.ndarray, key: np.ndarray, model: np.ndarray, n_models: int, settings: Settings
) -> list[Trees]:
    """A model for each value of ``model`` (0, 1, …; rows of one model in a row)."""
    n, width = x.shape
    depth, nodes = settings.depth, (1 << (settings.depth + 1)) - 1
    starts = np.searchsorted(model, np.arange(n_models + 1))
    codes = np.zeros((n, width), np.int64)
    edges = np.full((n_models, width, settings.bins + 1), np.nan)
    edges[:, :, 0] = -np.inf  # a split above the missing values alone
    base = np.zeros(n_models)
    for k in range(n_models):
        part = slice(starts[k], starts[k + 1])
        for f in range(width):
            found = bin_edges(x[part, f], settings.bins)
            codes[part, f] = codes_of(x[part, f], found)
            edges[k, f, 1 : len(found) + 1] = found
        base[k] = y[part].mean() if starts[k + 1] > starts[k] else 0.0
    n_bins = int(codes.max(initial=0)) + 1
    features = np.full((n_models, settings.trees, nodes), -1, np.int16)
    thresholds, values = np.zeros((2, n_models, settings.trees, nodes))
    gains, splits = np.zeros((n_models, width)), np.zeros((n_models, width), np.int64)
    predicted = base[model]
    for tree in range(settings.trees):
        columns = sampled_columns(width, tree, settings)
        seen, chosen = sampled_rows(key, tree, settings), codes[:, columns]
        gradient = predicted - y
        alive, slot = np.arange(n), model.copy()
        for level in range(depth + 1):
            mine = seen[alive]
            slots, inverse = np.unique(slot[alive][mine], return_inverse=True)
            if not len(slots):
                break
            g = gradient[alive[mine]]
            sums = np.bincount(inverse, weights=g, minlength=len(slots))
            counts = np.bincount(inverse, minlength=len(slots)).astype(float)
            best, most = np.full(len(slots), -1), np.zeros(len(slots))
            feature = edge = np.zeros(len(slots), np.int64)
            if level < depth and len(columns):
                # bins first: running sums over them are additions of whole rows
                cells = len(slots) * len(columns)
                cell = chosen[alive[mine]] * cells
                cell += (inverse * len(columns))[:, None] + np.arange(len(columns))
                cell, shape = cell.ravel(), (n_bins, len(slots), len(columns))
                left = np.bincount(cell, weights=np.repeat(g, len(columns)), minlength=n_bins * cells).reshape(shape)
                below = np.bincount(cell, minlength=n_bins * cells).astype(float).reshape(shape)
                np.cumsum(left, axis=0, out=left)
                np.cumsum(below, axis=0, out=below)
                above, right = counts[:, None] - below, sums[:, None] - left
                nowhere = (below < 1) | (above < 1)
                below += settings.l2
                above += settings.l2
                gain = left * left / below
                right *= right
                right /= above
                gain += right
                gain -= (sums**2 / (counts + settings.l2))[:, None]
                np.copyto(gain, -np.inf, where=nowhere)
                most = gain.max(axis=(0, 2))
                near = gain >= (most - TIE * np.abs(most))[:, None]
                feature = near.any(0).argmax(1)
                edge = near[:, np.arange(len(slots)), feature].argmax(0)
                best = np.where(most > settings.min_gain, feature, -1)
                feature = columns[feature]
            at = np.minimum(np.searchsorted(slots, slot[alive]), len(slots) - 1)
            known = slots[at] == slot[alive]
            value = -sums / (counts + settings.l2) * settings.rate
            k, node = slots >> level, (1 << level) - 1 + (slots & ((1 << level) - 1))
            leaf = best < 0
            values[k[leaf], tree, node[leaf]] = value[leaf]
            k, node, f, b = k[~leaf], node[~leaf], feature[~leaf], edge[~leaf]
            features[k, tree, node] = f
            thresholds[k, tree, node] = edges[k, f, b]
            np.add.at(gains, (k, f), most[~leaf] if len(k) else 0.0)
            np.add.at(splits, (k, f), 1)
            ends = known & (best[at] < 0)
            predicted[alive[ends]] += value[at[ends]]
            goes = known & ~ends
            alive, at = alive[goes], at[goes]
            slot[alive] = slot[alive] * 2 + (codes[alive, feature[at]] > edge[at])
    return [
        Trees(float(base[k]), features[k], thresholds[k], values[k], gains[k], splits[k]) for k in range(n_models)
    ]


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """The model's value at each row of ``x``."""
    n, (trees, _) = len(x), model.feature.shape
    tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
    node = np.zeros((n, trees), np.int64)
    while True:
        f = model.feature[tree, node]
        inner = f >= 0
        if not inner.any():
            break
        right = x[row, np.maximum(f, 0)] > model.threshold[tree, node]  # missing is not larger
        node = np.where(inner, node * 2 + 1 + right, node)
    return model.base + model.value[tree, node].sum(1)


def _matrix(table, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([_doubles(table, c) for c in features]) if features else np.zeros((table.num_rows, 0))


def _doubles(table, name: str) -> np.ndarray:
    return table.column(name).cast("double").to_numpy(zero_copy_only=False).astype(float)


def _cast(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def fit_boosted(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    by: Sequence[str] = ("zone",),
    settings: Settings | None = None,
    min_rows: int = MIN_HOUR_ROWS,
) -> DataFrame:
    """One model per group: ``by…, n_rows, model`` (bytes) and ``importance``.

    Rows without a target are left out, missing features go to the lower side of every split;
    groups with fewer than ``min_rows`` rows get no model. ``importance`` is the mean gain of the
    splits on each feature, scaled to one.
    """
    import pyarrow as pa

    settings = settings or Settings()
    rows = _cast(df.where(F.col(target).isNotNull()), [*features, target])
    rows = rows.select(*by, hour_no("ts_utc").cast("bigint").alias("_at"), *features, target)
    schema = f"{_types(df, by)}, n_rows long, model binary, importance array<double>"

    def fit(table):
        table = table.sort_by("_at")
        n = table.num_rows
        if n < min_rows:
            table = table.slice(0, 0)
            return table.select([*by]).append_column("n_rows", pa.array([], pa.int64())).append_column(
                "model", pa.array([], pa.binary())
            ).append_column("importance", pa.array([], pa.list_(pa.float64())))
        (made,) = train(
            _matrix(table, features), _doubles(table, target), table.column("_at").to_numpy(),
            np.zeros(n, np.int64), 1, settings,
        )
        mean = made.gain / np.maximum(made.splits, 1)
        share = mean / mean.sum() if mean.sum() > 0 else mean
        return pa.table({
            **{c: table.column(c).slice(0, 1) for c in by}, "n_rows": pa.array([n], pa.int64()),
            "model": pa.array([made.to_bytes()], pa.binary()),
            "importance": pa.array([share.tolist()], pa.list_(pa.float64())),
        })

    return rows.groupBy(*by).applyInArrow(fit, schema)


def predict_boosted(
    models: DataFrame, df: DataFrame, features: Sequence[str], by: Sequence[str] = ("zone",), block_hours: int = 2160
) -> DataFrame:
    """``df`` with ``predicted_price`` of its group's model; 0 where a group has none.

    Rows meet their model in 90-day blocks of a group, and a model is copied to each block that has
    rows, so that a long or frequent group is no single task.
    """
    import pyarrow as pa

    rows = df.withColumn("_block", F.floor(hour_no("ts_utc") / block_hours).cast("bigint"))
    keys = [*by, "_block"]
    blocks = rows.select(*keys).distinct()
    # columns of their own: a cogroup mixes up sides that share some
    sent = blocks.join(models.select(*by, "model"), [*by]).select(*[F.col(c).alias(f"_its_{c}") for c in keys], "model")

    def score(part, found):
        made = np.zeros(part.num_rows)
        if found.num_rows:
            model = Trees.from_bytes(found.column("model")[0].as_py())
            made = predict(model, _matrix(part, features))
        return part.select(names).append_column("predicted_price", pa.array(made, pa.float64()))

    names = df.columns
    schema = f"{_types(df, names)}, predicted_price double"
    theirs = sent.groupBy(*[f"_its_{c}" for c in keys])
    return rows.groupBy(*keys).cogroup(theirs).applyInArrow(score, schema)


def importance_table(models: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Importance per feature, averaged over the models of each group of ``by``, largest first."""
    named = models.select(
        *by, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), "importance")).alias("_i")
    )
    return (
        named.groupBy(*by, F.col("_i.feature").alias("feature"))
        .agg(F.avg("_i.importance").alias("importance"))
        .orderBy(*by, F.desc("importance"), "feature")
    )


def walk_forward_boosted(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    window_days: int = 56,
    min_rows: int = MIN_TRAIN_ROWS,
    settings: Settings | None = None,
    day_tz: str = MARKET_TZ,
    by: Sequence[str] = ("zone",),
    folds: DataFrame | None = None,
    per_hour: bool = False,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Boosted trees refitted for every fold day on the ``window_days`` days before it.

    Fold days are cut into blocks of ``block_days``; a block's task gets the rows of its days and of
    the window before, so each row is copied to at most 1 + window_days / block_days (rounded up)
    blocks instead of once per fold, and blocks without folds are never sent. All folds of a block
    grow together. ``folds`` (by…, fold_day) restricts the days; default are all days at least
    ``window_days`` after a zone's first. Rows need a target to train, a missing feature is allowed.
    ``per_hour`` fits a model for each local hour from at least ten rows; an hour without one is
    predicted 0 where its fold has ``min_rows`` rows.
    Returns ``by…, ts_utc, local_date, predicted_price, actual_price``.
    """
    import pyarrow as pa

    settings = settings or Settings()
    rows = _cast(df, [*features, target]).select(
        *by, "ts_utc", local_date("ts_utc", day_tz).alias("local_date"),
        local_hour("ts_utc", day_tz).cast("int").alias("_hour"),
        hour_no("ts_utc").cast("bigint").alias("_at"), *features, target,
    )
    rows = rows.withColumn("_day", F.unix_date("local_date"))
    if folds is None:
        folds = fold_days(rows, "local_date", window_days, by)
    marked = folds.select(*by, F.unix_date("fold_day").alias("_day")).distinct()
    home = F.floor(F.col("_day") / block_days)
    reach = F.floor((F.col("_day") + window_days) / block_days)
    wanted = marked.select(*by, home.alias("_block")).distinct()
    sent = (
        rows.join(marked.withColumn("_fold", F.lit(True)), [*by, "_day"], "left")
        .withColumn("_block", F.explode(F.sequence(home, reach)))
        .join(wanted, [*by, "_block"], "left_semi")
    )
    schema = f"{_types(df, by)}, ts_utc {df.schema['ts_utc'].dataType.simpleString()}, local_date date, " \
             "predicted_price double, actual_price double"

    def forecasts(table):
        table = table.sort_by("_at")
        day = table.column("_day").to_numpy()
        block = int(table.column("_block")[0].as_py())
        flagged = table.column("_fold").is_valid().to_numpy(zero_copy_only=False)
        flagged &= day // block_days == block
        hour, key = table.column("_hour").to_numpy(), table.column("_at").to_numpy()
        x, y = _matrix(table, features), _doubles(table, target)
        usable = ~np.isnan(y)
        made = np.full(table.num_rows, np.nan)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def grow():
            if not waiting:
                return
            at = np.concatenate([t for t, _ in waiting])
            model = np.repeat(np.arange(len(waiting)), [len(t) for t, _ in waiting])
            for trees, (_, test) in zip(train(x[at], y[at], key[at], model, len(waiting), settings), waiting, strict=True):
                made[test] = predict(trees, x[test])
            waiting.clear()

        gathered = 0
        for fold in np.unique(day[flagged]):
            lo, hi = np.searchsorted(day, [fold - window_days, fold])
            past = np.arange(lo, hi)[usable[lo:hi]]
            test = np.arange(hi, np.searchsorted(day, fold, "right"))
            if len(past) < min_rows:
                continue
            groups = [(past, test)]
            if per_hour:
                made[test] = 0.0
                groups = [(past[hour[past] == h], test[hour[test] == h]) for h in np.unique(hour[test])]
                groups = [(p, t) for p, t in groups if len(p) >= MIN_HOUR_ROWS]
            for group in groups:
                waiting.append(group)
                gathered += len(group[0])
                if gathered >= BATCH_ROWS:
                    grow()
                    gathered = 0
        grow()
        done = np.flatnonzero(~np.isnan(made))
        out = table.take(pa.array(done)).select([*by, "ts_utc", "local_date", target])
        out = out.add_column(len(by) + 2, "predicted_price", pa.array(made[done]))
        return out.rename_columns([*by, "ts_utc", "local_date", "predicted_price", "actual_price"])

    return sent.groupBy(*by, "_block").applyInArrow(forecasts, schema)


def permutation_importance(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    features: Sequence[str],
    by: Sequence[str] = ("zone",),
    predicted: str = "predicted_price",
    chunk_hours: int = 720,
    seed: int = 42,
) -> DataFrame:
    """How much the RMSE grows when one feature's values change places: ``by…, feature, importance``.

    Inside each (group, ``chunk_hours``) the rows, ordered by time, take the feature's values ordered
    by a seeded hash of their hour. ``score`` turns rows with the features into rows with
    ``predicted`` and must keep the column ``feature``; it is called once, on one copy of the rows
    per feature and the untouched ones.
    """
    key = [*by, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(hour_no("ts_utc") / chunk_hours))
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ts_utc", *features, target))).alias("_rows"))

    def shuffled(feature: str) -> Column:
        order = F.array_sort(F.transform(
            "_rows", lambda r: F.struct(F.xxhash64(r["ts_utc"], F.lit(feature), F.lit(seed)), r["ts_utc"], r[feature])
        ))
        return F.transform("_rows", lambda r, i: r.withField(feature, order[i][feature]))

    copies = F.array(
        F.struct(F.lit(None).cast("string").alias("feature"), F.col("_rows").alias("rows")),
        *[F.struct(F.lit(c).alias("feature"), shuffled(c).alias("rows")) for c in features],
    )
    stacked = (
        held.select(*key, F.explode(copies).alias("_c"))
        .select(*by, "_c.feature", F.explode("_c.rows").alias("_r"))
        .select(*by, "feature", "_r.*")
    )
    errors = score(stacked).groupBy(*by, "feature").agg(rmse(F.col(target), F.col(predicted)).alias("_rmse"))
    base = errors.where("feature IS NULL").select(*by, F.col("_rmse").alias("_base"))
    return (
        errors.where("feature IS NOT NULL").join(base, list(by))
        .select(*by, "feature", (F.col("_rmse") - F.col("_base")).alias("importance"))
    )
