import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical, key
from entries import all_queries, all_sql

SF = "/root/testdata/sf0.001"
# one or two per family; check.py runs them all
NAMES = [
    "a08_normalise_spot", "b08_clip_to_quantiles", "c09_reconcile", "d01_limited_forward_fill",
    "e15_feature_matrix", "f07_autocorrelation", "g11_walk_forward_single_feature",
    "h15_backtest_summary", "i02_drift_status", "j04_overlap_exclusion",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = sorted(set(all_queries()) - set(all_sql()))
    assert without == [
        "d17_zone_quality_messages", "g02_boosted_per_zone", "g02_boosted_trees", "g03_boosted_per_hour",
        "g03_g04_per_hour_ridge", "g05_boosted_importance_per_zone", "g05_feature_importance",
        "g05_mean_importance_over_hours", "g05_permutation_importance", "g11_boosted_sampled",
        "g11_boosted_sampled_per_hour", "g11_sampled_walk_forward", "g11_walk_forward",
    ]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(entry.oracle_sql()[name])
    want_cols, want_rows = canonical([c[0] for c in want.description], want.fetchall())
    assert cols == want_cols and len(rows) == len(want_rows)
    assert [[key(v) for v in r] for r in rows] == [[key(v) for v in r] for r in want_rows]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
