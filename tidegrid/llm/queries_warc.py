"""All pages as WARC archives and back."""

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.warc import archive_pages


def op7_loser_tree_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, digest and record type of every page, from the merged index of the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_pages(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {"op7_loser_tree_index": op7_loser_tree_index}
SQL = {
    "op7_loser_tree_index": """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as b, sha256(coalesce(html, '')) as d
  from pages),
f as (select d, min(page_id) as first_id from p where b >= 100 group by d)
select page_id, b as payload_bytes, p.d as payload_digest,
  case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from p left join f on p.d = f.d
"""
}
