import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = dt.datetime(2025, 1, 5, 23)  # Monday 00:00 in Copenhagen


def hours(n, start=START):
    return [start + dt.timedelta(hours=i) for i in range(n)]


@pytest.fixture
def series(spark):
    """Two zones of n hourly rows with the given columns: name -> array or fn(rng, n)."""

    def make(n=168, start=START, zones=("A", "B"), seed=42, drop=(), **cols):
        parts = []
        for z, zone in enumerate(zones):
            rng = np.random.default_rng(seed + z)
            data = {"zone": zone, "ts_utc": hours(n, start)}
            for name, v in cols.items():
                data[name] = v(rng, n) if callable(v) else v
            frame = pd.DataFrame(data)
            parts.append(frame.drop(index=list(drop)))
        pdf = pd.concat(parts, ignore_index=True)
        return to_spark(spark, pdf), pdf

    return make


def to_spark(spark, pdf):
    """Spark frame with NTZ timestamps and NULL for NaN."""
    from tidegrid.sources.schemas import nan_to_null

    schema = ", ".join(
        f"`{c}` " + (
            "timestamp_ntz" if str(t).startswith("datetime") else
            "double" if str(t).startswith("float") else
            "bigint" if str(t).startswith("int") else
            "boolean" if str(t) == "bool" else "string"
        )
        for c, t in pdf.dtypes.items()
    )
    rows = [
        tuple(
            v.to_pydatetime() if isinstance(v, pd.Timestamp) else
            v.item() if hasattr(v, "item") else v
            for v in row
        )
        for row in pdf.itertuples(index=False)
    ]
    return nan_to_null(spark.createDataFrame(rows, schema))


def to_pandas(df, *order):
    return df.toPandas().sort_values(list(order or ("zone", "ts_utc"))).reset_index(drop=True)


@pytest.fixture
def prices(series):
    wave = lambda rng, n: 40 + 20 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 5, n)
    return lambda n=168, **kw: series(n, price_eur_mwh=wave, **kw)
