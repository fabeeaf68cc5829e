"""Byte-level BPE of all documents, and back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe
from tidegrid.llm.common import staged


def op8_numpy_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of their text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = bpe.encode(docs, path).select("doc_id", "n_tokens", "ids")
    back = bpe.decode(tokens, path)
    return staged(
        back.select(
            "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        ),
        "bpe-digests",
    )


QUERIES = {"op8_numpy_merge_rounds": op8_numpy_merge_rounds}
SQL: dict = {}
