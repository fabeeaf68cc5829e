"""Quality rules: a ledger of failure bits and measurements, and policies over it.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit for each
failed rule; a policy is a named, versioned mask of rules. Applying another policy or asking what a
rule alone rejects is arithmetic on the bits and never reads a text again. All expressions are
Spark's own; nothing is shuffled but the grouped counts of an ablation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import fresh_names

#: Rules in bit order: name and SQL condition that fails a document, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": tuple(RULES),
}
MEASURES = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words".split()

_SPACE = r"[\\x20\\x09-\\x0D]"


def mask(rules) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _repeated(words: str) -> str:
    """SQL for the words inside 3-word windows that occur twice or more; ``words`` is an array.

    Windows are compared by a 64-bit hash. Only texts where a window repeats are sorted: by (hash,
    place), so that equal windows are neighbours; their places, in order, cover 3 words each or what
    is left up to the next place.
    """
    windows = (
        f"transform(sequence(0, size({words}) - 3),"
        f" i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    )
    ordered = "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))"
    twins = (
        "transform(filter(transform(s, (e, k) -> struct(e.i as i,"
        " (k > 0 and s[k - 1].x = e.x) or (k + 1 < size(s) and s[k + 1].x = e.x) as twin)),"
        " e -> e.twin), e -> e.i)"
    )
    cover = (
        "aggregate(sort_array(p), struct(0L as n, -3 as last),"
        " (a, q) -> struct(a.n + least(3, q - a.last) as n, q as last), a -> a.n)"
    )
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    repeated = bind(ordered, "s", bind(twins, "p", cover))
    return (
        f"case when size({words}) < 4 then 0L else "
        + bind(windows, "h", f"case when size(array_distinct(h)) = size(h) then 0L else {repeated} end")
        + " end"
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements, ``n_lines`` (lines with a word) and ``failed_bits``.

    A null or empty text has no words, so every measure is 0 and ``few_words`` fails. Repeated rows
    and ids are judged row by row. Very long texts are measured whole, in memory that grows with one
    text; an empty table gives an empty table. Other columns are kept, those with one of the new
    names replaced.
    """
    gap = _SPACE.replace("\\\\", "\\")
    new = [*MEASURES, "failed_bits"]
    kept = [c for c in docs.columns if c not in new or c == text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole, words, lines_of = fresh_names([*docs.columns, *new], "__text", "__words", "__lines")
    base = docs.select(*[F.col(f"`{c}`") for c in kept], body.alias(whole)).withColumn(
        words, F.filter(F.split(whole, f"{gap}+"), lambda w: w != "")
    )
    lines = f"filter(split({whole}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    measured = base.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", "")))
        .cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> struct(size(l) as n, size(array_distinct(l)) as d))[0]")
        .alias(lines_of),
        F.expr(_repeated(words)).alias("n_repeat_words"),
    )
    counted = measured.select(
        *[F.col(f"`{c}`") for c in measured.columns if c != lines_of],
        F.col(f"{lines_of}.n").cast("long").alias("n_lines"),
        (F.col(f"{lines_of}.n") - F.col(f"{lines_of}.d")).cast("long").alias("n_dup_lines"),
    )
    bits = " | ".join(
        f"if({condition}, {1 << k}L, 0L)" for k, condition in enumerate(RULES.values())
    )
    return counted.withColumn("failed_bits", F.expr(bits)).select(
        *[F.col(f"`{c}`") for c in kept], *new
    )


def apply_policy(kept: DataFrame, rules) -> DataFrame:
    """The ledger with ``kept``: true where no rule of the policy failed."""
    return kept.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(rules))) == 0)


def keep_passing(rows: DataFrame, rules) -> DataFrame:
    """The rows of a ledger that no rule of the policy rejects.

    The verdict passes through a generator of one row: a plain filter would be pushed below the
    measurements, and repeat their work inside its condition.
    """
    judged = apply_policy(rows, rules)
    return judged.withColumn("kept", F.explode_outer(F.array("kept"))).where("kept")


def ablations(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: rejected by the policy, failed by the rule, rejected by it alone.

    ``kept_without`` counts the documents that the policy would keep without the rule. Equal bit
    patterns are counted first; there are at most 2^rules of them, whatever the number of rows.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    cases = [
        (version, rule, mask(chosen), 1 << names.index(rule))
        for version, chosen in policies.items()
        for rule in chosen
    ]
    hit = lambda bits: F.col("failed_bits").bitwiseAND(bits)
    spread = patterns.withColumn(
        "case",
        F.explode(F.array(*[
            F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"),
                     F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"))
            for v, r, m, b in cases
        ])),
    ).select("failed_bits", "n", "case.*")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return spread.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"),
        count(hit(F.col("mask")) != 0).alias("rejected"),
        count(hit(F.col("bit")) != 0).alias("failed_rule"),
        count(hit(F.col("mask")) == F.col("bit")).alias("rejected_by_it_alone"),
        count((hit(F.col("mask")) == 0) | (hit(F.col("mask")) == F.col("bit"))).alias("kept_without"),
    )
