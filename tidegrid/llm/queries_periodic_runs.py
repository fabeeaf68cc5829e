"""Periodic runs of all documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import BATCH_ROWS, arrow_rows
from tidegrid.llm.periodic_runs import longest_run, periodic_runs


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The contract's text: in a tenth of the documents (by the id's CRC) a part repeats itself."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    part = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(part, times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(text)


def op11_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest and digest of each document's periodic runs, and digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        rows = periodic_runs(docs).withColumn("best", longest_run())
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_kruskal_runs": op11_kruskal_runs}
SQL: dict = {}
