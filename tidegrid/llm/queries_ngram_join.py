"""Near-duplicate groups of all documents."""

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.ngram_join import ngram_components


def op1_vertical_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at five words and a similarity of 0.8: a finder of
    components. Links are counted by ``ngram_components`` itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = ngram_components(docs, words=5, num=4, den=5, count_links=False)
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_vertical_fragment_join": op1_vertical_fragment_join}
SQL = {
    "op1_vertical_fragment_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from d),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as n, count(*) as c
  from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * c >= 80 * (n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from s left join (select a, min(b) as m from r group by a) t on doc_id = t.a
"""
}
