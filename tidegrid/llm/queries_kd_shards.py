"""All documents in eight shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.kd_shards import kd_shards

SHARDS = 8


def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards have nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return kd_shards(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_kd_tree_shards": op2_kd_tree_shards}
SQL: dict = {}
