import numpy as np
import pytest
from brute import Groups

from tidegrid.llm import vector_dedup as vd


def unit(rng, n, d=24):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def near(rng, x, spread):
    y = x + spread * unit(rng, len(x), x.shape[1])
    return y / np.linalg.norm(y, axis=1)[:, None]


def brute(rows, least):
    good = {
        k: np.asarray(np.float32(v), np.float64) for k, (_, v) in enumerate(rows)
        if v is not None and len(v) == 24 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    }
    keys = list(good)
    x = np.stack([good[k] / np.linalg.norm(good[k]) for k in keys])
    linked = x @ x.T >= least
    groups = Groups(range(len(rows)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.join(keys[a], keys[b])
    degree = dict.fromkeys(range(len(rows)), 0) | dict(zip(keys, (linked.sum(1) - 1).tolist(), strict=True))
    return degree, {k: groups.find(k) for k in range(len(rows))}


@pytest.mark.parametrize("chunk", [4_000, 60])
def test_links_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vd, "SHARD", 150)
    monkeypatch.setattr(vd, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    base = unit(rng, 300)
    x = np.concatenate([base, near(rng, base[:40], 0.15), near(rng, np.repeat(base[:1], 90, 0), 0.25)])
    vectors = [v.tolist() for v in x] + [x[3].tolist()] * 5
    vectors += [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] * 24, [1.0] * 7]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(
        [(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, node int, shard string"
    )
    got = {r.vec_id: r for r in vd.vector_components(frame).collect()}
    degree, group = brute(rows, 0.95)
    links = sum(degree.values())
    assert links > 500 and all(got[k].n_links <= degree[k] for k in degree)
    assert sum(r.n_links for r in got.values()) >= 0.99 * links
    same = sum(got[k].component_id == group[k] for k in group)
    assert same >= 0.99 * len(group) and got[0].recall >= 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_ids_that_repeat_or_are_null_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = vd.vector_components(spark.createDataFrame([(4, v), (4, v), (None, v), (2, w), (None, None)], schema))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows.collect())
    assert got == [(0, 0, 0), (0, 2, 4), (2, 0, 2), (4, 2, 4), (4, 2, 4)]
    assert vd.vector_components(spark.createDataFrame([], schema)).count() == 0
    one = vd.vector_components(spark.createDataFrame([(1, v)], schema)).first()
    assert (one.n_links, one.component_id, one.kept) == (0, 1, True)


def test_search_reaches_every_part_of_a_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([near(rng, np.repeat(c[None], 50, 0), 0.2) for c in unit(rng, 6)])
    graph = vd.connect(x, vd.build_graph(x, 1), 0)
    sims = x @ x.T
    for k in range(len(x)):
        found = vd.search(x, graph, 0, x[k], 0.95, 32)
        assert set(found.tolist()) <= set(np.flatnonzero(sims[k] >= 0.95).tolist()) and k in found


def test_one_vector_builds_a_graph():
    x = unit(np.random.default_rng(0), 1)
    assert [g.tolist() for g in vd.connect(x, vd.build_graph(x, 0), 0)] in ([[]], [[0]])


def test_the_exact_way_when_recall_is_missed(spark, monkeypatch):
    monkeypatch.setattr(vd, "TARGET", 2.0)
    monkeypatch.setattr(vd, "TRIES", ((1, 4),))
    monkeypatch.setattr(vd, "SHARD", 100)
    monkeypatch.setattr(vd, "CHUNK", 70)
    rng = np.random.default_rng(8)
    x = unit(rng, 200)
    x = np.concatenate([x, near(rng, x[:100], 0.2), near(rng, np.repeat(x[:1], 60, 0), 0.25), x[:5]])
    rows = list(enumerate(np.float32(x).astype(float).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    degree, group = brute(rows, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id, r.recall) for r in vd.vector_components(frame).collect()}
    assert got == {k: (degree[k], group[k], 1.0) for k in degree} and sum(degree.values()) > 300


def test_doubles_and_every_length(spark):
    schema = "vec_id long, embedding array<double>"
    c = 0.95 + 1e-9
    rows = [(1, [1.0, 0.0]), (2, [c, (1 - c * c) ** 0.5]), (3, [0.95 - 1e-9, (1 - (0.95 - 1e-9) ** 2) ** 0.5])]
    got = {r.vec_id: r.n_links for r in vd.vector_components(spark.createDataFrame(rows[:2], schema)).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.vec_id: r.n_links for r in vd.vector_components(spark.createDataFrame(rows[::2], schema)).collect()}
    assert got == {1: 0, 3: 0}
    mixed = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.001]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.01, 0.0]), (7, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vd.vector_components(spark.createDataFrame(mixed, schema)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (0, 5), 6: (1, 4), 7: (0, 7)}
