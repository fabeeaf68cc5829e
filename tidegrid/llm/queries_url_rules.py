"""URL rules over all pages."""

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.url_rules import RULE_SCHEMA, judge_urls

#: The rules of the query: host, path, verdict (fixed values).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_sorted_rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; pages without a rule are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judge_urls(pages, rules, default="allow").select(
        "page_id", "host", "path", "rule", "verdict"
    )


QUERIES = {"op6_sorted_rule_sweep": op6_sorted_rule_sweep}

_VALUES = ", ".join(str(r) for r in RULES)
SQL = {
    "op6_sorted_rule_sweep": rf"""
with r(h, p, v) as (values {_VALUES}),
a as (select page_id, case when position('://' in url) > 0
  then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
m as (select distinct host, path, h || p as rule, v, length(h || p) as n, length(h) as k
  from (select distinct host, path from c) x join r
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
best as (select host, path, rule, v from m
  qualify row_number() over (partition by host, path order by n desc, k desc, v desc) = 1)
select page_id, c.host, c.path, rule, coalesce(v, 'allow') as verdict
from c left join best on c.host = best.host and c.path = best.path
"""
}
