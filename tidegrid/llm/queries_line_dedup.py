"""Line dedup over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.line_dedup import dedup_lines


def op4_simhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of what is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.octet_length("text").cast("long").alias("bytes_left"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


QUERIES = {"op4_simhash_line_dedup": op4_simhash_line_dedup}
SQL: dict = {}
