"""Near-duplicate groups of all embeddings."""

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.vector_dedup import vector_components


def op9_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95, and the audited recall."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_components(vectors, 0.95)


QUERIES = {"op9_robust_pruned_graph": op9_robust_pruned_graph}
SQL = {
    "op9_robust_pruned_graph": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
  and list_bool_and([isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
  vec_id <= coalesce(m, vec_id) as kept, 1::double as recall
from embeddings left join (select a, count(*) as n from l group by a) c on vec_id = c.a
left join (select a, min(b) as m from r group by a) d on vec_id = d.a
"""
}
