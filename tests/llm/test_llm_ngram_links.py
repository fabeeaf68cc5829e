"""Exact links of the n-gram join against brute force."""

import random

from brute import shingles

from tidegrid.llm import ngram_join as nj

RNG = random.Random(5)


def test_links_inside_a_family_are_all_counted(spark):
    base = [f"n{RNG.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(RNG.randrange(4)):
            words[RNG.randrange(200)] = f"n{RNG.randrange(5000)}"
        texts.append(" ".join(words))
    texts += texts[:5] + ["a text of its own entirely"]
    docs = list(enumerate(texts))
    sets = {i: shingles(t) for i, t in docs}
    want = {
        i: sum(j != i and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()
    }
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in nj.ngram_components(frame).collect()} == want
    assert min(want.values()) == 0 and max(want.values()) > 20
    assert "n_links" not in nj.ngram_components(frame, count_links=False).columns
