"""Alignment of two public tokenizers over all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import staged
from tidegrid.llm.token_alignment import align, with_link_counts


def op13_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and their corpus-wide counts of each document."""
    paths = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = align(docs, *paths)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = staged(rows.withColumn("groups_sha256", digest).drop("text", "groups"), "token-alignment")
    return with_link_counts(rows).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES = {"op13_interval_alignment": op13_interval_alignment}
SQL: dict = {}
