"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ngram_join", "kd_shards", "packing", "line_dedup", "url_rules", "warc", "bpe", "vector_dedup", "quality", "periodic_runs", "token_alignment", "substring_dedup")


def all_queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    out = {}
    for name in MODULES:
        out.update(import_module(f"tidegrid.llm.queries_{name}").QUERIES)
    return out


def all_sql() -> dict:
    """Name -> DuckDB statement."""
    out = {}
    for name in MODULES:
        out.update(import_module(f"tidegrid.llm.queries_{name}").SQL)
    return out
