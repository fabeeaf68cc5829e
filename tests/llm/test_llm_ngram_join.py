import random

import numpy as np
import pytest
from brute import near_groups

from tidegrid.llm import ngram_join as nj

RNG = random.Random(11)
NAMES = [f"n{k}" for k in range(2000)]


def edited(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = RNG.choice(NAMES)
    return " ".join(words)


def corpus():
    passage = " ".join(RNG.choice(NAMES) for _ in range(60))
    docs = [
        None, "", " \n", "one", "One  ONE", "one two", "a b c d e", "A b\tc d\x0be", "a b c d e f",
        "a a a a a a a a a", "é É é É é", "é é é É é",
    ]
    for size in (6, 9, 12, 20, 40, 80, 200):
        for _ in range(3):
            base = " ".join(RNG.choice(NAMES) for _ in range(size))
            docs += [base] * 2 + [edited(base, RNG.randrange(max(2, size // 25) + 1)) for _ in range(9)]
            docs += [base + " " + " ".join(RNG.choice(NAMES) for _ in range(size // 8))]
    docs += [passage + " " + " ".join(RNG.choice(NAMES) for _ in range(80)) for _ in range(25)]
    # a chain whose ends don't link
    words = [RNG.choice(NAMES) for _ in range(160)]
    docs += [" ".join(words[k : k + 100]) for k in range(0, 60, 6)]
    RNG.shuffle(docs)
    return list(enumerate(docs, 1000))


def test_groups_match_brute_force(spark):
    docs = corpus()
    rows = [(i, t, "x", 5) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(frame).collect()}
    want = near_groups(docs)
    assert got == want
    assert 40 < len({c for _, c in want.values()}) < len(docs) - 100


def test_ids_that_repeat_or_are_null(spark):
    text, other = "a b c d e f g h i j", "k l m n o p q r s t u v"
    docs = spark.createDataFrame(
        [(5, text), (5, text), (5, other), (7, other), (None, text), (None, "alone " * 9), (9, text)],
        "doc_id long, text string",
    )
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in nj.ngram_components(docs).collect())
    assert rows == [(0, 1, None), (0, 6, 5), (5, 6, 5), (5, 6, 5), (5, 8, 5), (7, 8, 5), (9, 6, 5)]
    left = sorted((r.doc_id or 0, r.text) for r in nj.drop_near_copies(docs).collect())
    assert left == [(0, "alone " * 9), (5, text), (5, other)]  # one row of each group


def test_no_rows_and_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert nj.ngram_components(docs.where("false")).count() == 0
    assert sorted((r.doc_id, r.component_id) for r in nj.ngram_components(docs).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("num, den", [(4, 5), (9, 10), (1, 2)])
def test_linked_sets_share_a_bucket(num, den):
    """The bound that candidates rest on, at the largest difference that still links."""
    rng = np.random.default_rng(num)
    for n in [*range(1, 60), 100, 333, 1000]:
        pool = np.unique(rng.integers(0, 2**63, 4 * n, dtype=np.uint64))
        for _ in range(8):
            a = np.sort(rng.choice(pool, n, replace=False))
            rest = np.setdiff1d(pool, a)
            # b keeps c of a and adds d others, with c / (n + d) >= num / den
            d = int(rng.integers(0, n * (den - num) // num + 1))
            c = -(-num * (n + d) // den)
            b = np.sort(np.r_[rng.choice(a, c, replace=False), rng.choice(rest, d, replace=False)])
            if len(b) and den * c >= num * (n + d):
                shared = np.intersect1d(nj.buckets(a, num, den), nj.buckets(b, num, den))
                assert len(shared), (n, c, d)


def test_size_classes_are_at_most_one_apart():
    for n in range(1, 3000):
        k, top = nj.size_class(n, 4, 5)
        assert n <= top and nj.size_class(n * 5 // 4, 4, 5)[0] <= k + 1


def test_near_copies_go_by_document(spark):
    from tidegrid.llm.ngram_join import drop_near_copies

    words = [f"w{k}" for k in range(100)]
    a, near, b = " ".join(words), " ".join([*words[:99], "z"]), " ".join(words[::-1])
    schema = "doc_id long, text string, near_id string"
    docs = spark.createDataFrame([(5, a, "p"), (7, a, "q"), (7, b, "r")], schema)
    assert sorted(map(tuple, drop_near_copies(docs).collect())) == [(5, a, "p"), (7, b, "r")]
    docs = spark.createDataFrame(
        [(None, a, "p"), (None, near, "q"), (8, b, "s"), (8, b, "r"), (9, None, "t"), (9, None, "t"), (9, "", "u")], schema
    )
    got = sorted((str(r.doc_id), str(r.text), r.near_id) for r in drop_near_copies(docs).collect())
    assert [g[2] for g in got] == ["r", "u", "t", "t", "p"] or [g[2] for g in got] == ["r", "u", "t", "t", "q"]
    assert drop_near_copies(docs.where("false")).count() == 0


def test_near_copies_without_ids_link(spark):
    from tidegrid.llm.ngram_join import ngram_components

    words = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:99], "z"])), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.component_id) for r in ngram_components(docs).collect())
    assert got == [(0, 1, None), (0, 1, None), (3, 0, 3)]
