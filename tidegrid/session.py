"""Session helpers: where durable intermediate data goes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    It is named in ``spark.checkpoint.dir``, or set on the context by
    ``setCheckpointDir``. Nothing is kept on one machine: a session without
    either is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one staged table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table; cuts lineage durably."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Make ``DataFrame.checkpoint()`` usable in this session."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark
