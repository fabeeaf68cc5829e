"""Packing all documents into sequences of 4096 token ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.sos_packing import pack_documents
from tidegrid.llm.token_output import packed_sequences, segments

WIDTH, END_ID = 4096, 1


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op3_segment_tree_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the packed id matrices and returns every segment as it is read back from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return segments(packed_sequences(_docs(spark, sf_dir), path, WIDTH, END_ID))


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_docs(spark, sf_dir), path, WIDTH, END_ID)


QUERIES = {
    "op3_segment_tree_output": op3_segment_tree_output,
    "op5_sum_of_squares_packing": op5_sum_of_squares_packing,
}
SQL: dict = {}
