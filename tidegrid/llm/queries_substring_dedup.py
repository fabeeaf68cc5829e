"""Passages of twenty words that repeat, over all documents."""

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.substring_dedup import drop_repeats

#: Words of a window.
WINDOW = 20


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of each document, and digest of the words that are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs, WINDOW, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op12_recompression": op12_recompression}
SQL: dict = {}
