"""Quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import quality


def op10_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document under the policy v2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = quality.mask(quality.POLICIES["base"])
    rows = quality.apply_policy(quality.ledger(docs), quality.POLICIES["v2"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept",
        "n_lines", "failed_bits",
    )


QUERIES = {"op10_rule_bitmask_ledger": op10_rule_bitmask_ledger}

SQL = {
    "op10_rule_bitmask_ledger": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
  [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] as l from d),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w),
tri as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from pos),
rep as (select doc_id, count(distinct p) as n from
  (select doc_id, unnest([i, i + 1, i + 2]) as p from tri where c > 1) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words,
  coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep on w.doc_id = rep.doc_id),
b as (select *, (case when n_words < 50 then 1 else 0 end
  + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
  + case when 10 * n_symbols > n_words then 4 else 0 end
  + case when 2 * n_dup_lines > n_lines then 8 else 0 end
  + case when word_chars < 3 * n_words or word_chars > 10 * n_words then 16 else 0 end)::bigint
  as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, n_lines, failed_bits from b
"""
}
