"""URL rules by a sort-merge range join of host and path prefixes.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's. Labels of
a host in reverse order, a NUL and the path make a canonical key, in which a rule's prefix is one
interval: from its key up to its key and a byte no UTF-8 text holds. A url takes part once for each
ancestor of its host that has rules. Rules and urls are sorted together by key and swept: a rule's
start pushes it on the stack of active nested rules, its end pops it, and a url sees the top. The
stack is a running `last` per depth. The longest rule over all ancestors wins.

The sweep runs in slices of one host and a salt. A host gets as many slices as its urls need, and its
rules are copied into each, so a host with a third of all urls is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import fresh_names, small_side, staged

#: Urls of one host in a slice of the sweep, on average.
SLICE_URLS = 20_000
RULE_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple:
    """Columns host and path of a url column; both empty where it is null or has no ``://``."""
    u = F.col(f"`{url}`")
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest))
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def _reversed(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host, path) -> F.Column:
    return F.concat(_reversed(host), F.lit("\0"), path).cast("binary")


def _sweep(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(url_host, url_path, rule struct) of every url and ancestor whose stack isn't empty.

    ``rules`` (host, path, verdict, slice) and ``urls`` (host, url_host, url_path, slice).
    """
    rule = F.struct("host", "path", "verdict")
    no_rule = F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    none = F.lit(None).cast("string")
    starts = rules.select(
        "host", "slice", _key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"),
        rule.alias("rule"), none.alias("url_host"), none.alias("url_path"),
    )
    ends = starts.select(
        "host", "slice", F.concat("key", F.expr("X'FF'")).alias("key"), F.lit(2).alias("kind"),
        no_rule.alias("rule"), "url_host", "url_path",
    )
    seen = urls.select(
        "host", "slice", _key(F.col("host"), F.col("url_path")).alias("key"),
        F.lit(1).alias("kind"), no_rule.alias("rule"), "url_host", "url_path",
    )
    by_key = Window.partitionBy("host", "slice").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    one = starts.where("slice = 0").union(ends.where("slice = 0"))
    deepest = one.select(F.sum(step).over(by_key).alias("d")).agg(F.max("d")).first()[0] or 0
    if not deepest:
        return seen.where("false").select("url_host", "url_path", "rule")
    swept = starts.union(seen).union(ends).withColumn("depth", F.sum(step).over(by_key))
    stack = [
        F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("rule")), True).over(by_key)
        for d in range(1, deepest + 1)
    ]
    return (
        swept.withColumn("stack", F.array(*stack))
        .where("kind = 1 and depth > 0")
        .select("url_host", "url_path", F.col("stack")[F.col("depth") - 1].alias("rule"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` (host, path, verdict): of rules that fit, the one with the longest text wins, then the
    longer host; a prefix given as both allow and block blocks. A page that no rule fits gets a null
    rule and ``default``. Null urls and urls without ``://`` have an empty host and path, which no
    rule with a host fits. Repeated urls are judged once; a very long url is one row like any other.
    Other columns are kept, those with one of the new names replaced; empty tables give an empty
    result or ``default`` for every page.
    """
    new = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(url)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    parsed = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in new], host.alias("host"), path.alias("path")
    )
    rules = staged(
        rules.where("host is not null and path is not null")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict")),
        "url-rules",
    )
    labels = F.split("url_host", r"\.", -1)
    suffixes = F.expr(
        "transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"
    )
    urls = (
        pages.select(host.alias("url_host"), path.alias("url_path"))
        .distinct()
        .withColumn("labels", labels)
        .select("url_host", "url_path", F.explode(suffixes).alias("host"))
    )
    hosts = staged(rules.select("host").distinct(), "url-rule-hosts")
    urls = staged(urls.join(small_side(hosts), "host"), "url-ancestors")
    slices = staged(
        urls.groupBy("host").agg(F.ceil(F.count("*") / SLICE_URLS).cast("int").alias("slices")),
        "url-slices",
    )
    dealt = small_side(slices)
    urls = urls.join(dealt, "host").withColumn(
        "slice", F.pmod(F.xxhash64("url_host", "url_path"), "slices").cast("int")
    )
    copies = rules.join(dealt, "host").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    text = F.concat("rule.host", "rule.path")
    best = staged(
        _sweep(copies, urls)
        .groupBy("url_host", "url_path")
        .agg(
            F.max(F.struct(
                F.length(text).alias("n"), F.length("rule.host").alias("h"), text.alias("rule"),
                F.col("rule.verdict").alias("verdict"),
            )).alias("best")
        )
        .select("url_host", "url_path", "best.rule", "best.verdict"),
        "url-verdicts",
    )
    its_host, its_path = fresh_names(parsed.columns, "url_host", "url_path")
    best = best.withColumnsRenamed({"url_host": its_host, "url_path": its_path})
    matched = parsed.join(
        best, (F.col("host") == F.col(its_host)) & (F.col("path") == F.col(its_path)), "left"
    )
    return matched.select(
        *kept, "host", "path", best["rule"], F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )
