import random

import pytest
from brute import Groups
from pyspark.sql import functions as F

from tidegrid.llm.common import components, linked_groups


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 400)
    edges = [(names[k], names[k + 1]) for k in range(120)]  # a long path of random ids
    edges += [(names[200], names[k]) for k in range(201, 300)]  # a star
    edges += [(names[300], names[301]), (names[301], names[300]), (names[302], names[302])]
    want = Groups({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    rows = components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {r.node: r.component for r in rows} == {
        x: want.find(x) for x in want.up if x != names[302]
    }


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


@pytest.mark.parametrize("star_rounds", [0, 1, 2])
def test_linked_groups_lose_no_link_between_groups(spark, star_rounds):
    """Numbers link when at most 3 apart; buckets are wide and overlap."""
    rng = random.Random(star_rounds)
    nodes = sorted(rng.sample(range(400), 120))
    members = [(b, n, n) for n in nodes for b in (n // 20, (n + 10) // 20 + 100)] + [(999, n, n) for n in nodes]
    frame = spark.createDataFrame(members, "bucket long, node long, info long")
    links = linked_groups(
        frame.select("bucket", "node"), frame.select("node", "info").distinct(), lambda p: p.where("b - a <= 3"), "t", F.abs(F.col("info_a") - F.col("info_b")) < 9,
        star_rounds,
    ).collect()
    want, got = Groups(nodes), Groups(nodes)
    for a in nodes:
        for b in nodes:
            if 0 < b - a <= 3:
                want.join(a, b)
    for r in links:
        assert 0 < r.b - r.a <= 3
        got.join(r.a, r.b)
    assert [got.find(n) for n in nodes] == [want.find(n) for n in nodes]
