"""Embedding near-dedup on a robust-pruned flat graph.

Vectors are dealt to the shards of their OVERLAP nearest centroids (fitted on a bounded sample); a
large shard is cut into chunks. Each chunk builds a graph: nearest and random members as candidates,
pruned so that no neighbour is much closer to a kept neighbour than to the vector itself. A vector's
lists from all its shards are united. Every vector then searches the chunks of its shards: a greedy
search from the chunk's medoid with a bounded beam, which goes on from every member in range until no
new one is in range. Found members are verified by their cosine in double precision.

A link counts in the first shard that its ends share, so counts need no list of pairs, and a chunk
returns one edge per member to the group it found. Recall is audited against brute force for a
bounded sample of vectors; below TARGET the search is repeated with more shards and a longer beam.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import components, small_side, staged

#: Members of a shard on average and of a chunk, vectors of the sample that centroids are fitted on,
#: and centroids at most (they travel with every task).
SHARD, CHUNK, SAMPLE, CENTROIDS = 1_500, 4_000, 20_000, 4_096
#: Neighbours kept, near and random candidates, and how much closer a neighbour may be to another.
DEGREE, NEAR, RANDOM, ALPHA = 20, 40, 24, 1.2
#: (shards per vector, beam) of the first search and of those after a poor audit.
TRIES = ((3, 32), (5, 64), (8, 128))
#: Audited vectors, and the share of their links that must be found.
AUDIT, TARGET = 512, 0.98


def _matrix(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_centroids(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means from evenly spread rows."""
    centers = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([(x[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(1))
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centers)
    return centers


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each unit vector: robust pruning of near and random candidates, both ways."""
    n = len(x)
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    near, loose = min(NEAR, n - 1), min(RANDOM, n - 1)
    for a in range(0, n, 256):
        block = x[a : a + 256]
        sims = block @ x.T
        rows = np.arange(len(block))
        sims[rows, a + rows] = -2.0
        pick = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.zeros((len(block), 0), int)
        pick = np.concatenate([pick, rng.integers(0, n, (len(block), loose))], axis=1)
        score = np.take_along_axis(sims, pick, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        pick, score = np.take_along_axis(pick, order, 1), np.take_along_axis(score, order, 1)
        far = np.maximum(2 - 2 * score, 0.0)  # squared distance to the vector
        alive = score > -1.5
        cand = x[pick]
        kept = [[] for _ in range(len(block))]
        for _ in range(DEGREE):
            any_left = alive.any(1)
            if not any_left.any():
                break
            best = alive.argmax(1)
            for r in np.flatnonzero(any_left).tolist():
                kept[r].append(int(pick[r, best[r]]))
            near_best = np.einsum("rkd,rd->rk", cand, cand[rows, best])
            between = np.maximum(2 - 2 * near_best, 0.0)
            alive &= (ALPHA**2 * between > far) & (pick != pick[rows, best][:, None])
            alive[rows, best] = False
        out.extend(np.array(k, np.int64) for k in kept)
    back: list[list[int]] = [[] for _ in range(n)]
    for k, neighbours in enumerate(out):
        for m in neighbours.tolist():
            if len(back[m]) < 2 * DEGREE:
                back[m].append(k)
    graph = [np.unique(np.r_[a, np.array(b, np.int64)]) for a, b in zip(out, back, strict=True)]
    return graph


def connect(x: np.ndarray, graph: list[np.ndarray], start: int) -> list[np.ndarray]:
    """The graph with an edge to every part that ``start`` doesn't reach."""
    n, seen = len(x), np.zeros(len(x), bool)

    def walk(first: int) -> None:
        seen[first] = True
        front = np.array([first])
        while len(front):
            new = np.unique(np.concatenate([graph[k] for k in front.tolist()] or [front[:0]]))
            front = new[~seen[new]]
            seen[front] = True

    walk(start)
    for k in range(n):
        if not seen[k]:
            reached = np.flatnonzero(seen)
            to = int(reached[(x[reached] @ x[k]).argmax()])
            graph[to] = np.r_[graph[to], k]
            graph[k] = np.r_[graph[k], to]
            walk(k)
    return graph


def search(
    x: np.ndarray, graph: list[np.ndarray], start: int, q: np.ndarray, least: float, beam: int
) -> np.ndarray:
    """Members whose cosine with ``q`` is at least ``least``, as far as the graph leads to them."""
    width = 4
    seen = np.zeros(len(x), bool)
    seen[start] = True
    at, sim = np.array([start]), np.array([x[start] @ q])
    todo = np.ones(1, bool)
    while True:
        open_ = np.flatnonzero(todo)
        if not len(open_):
            break
        inside = open_[sim[open_] >= least]  # every member in range is expanded
        chosen = inside if len(inside) else open_[:width]
        todo[chosen] = False
        new = np.unique(np.concatenate([graph[k] for k in at[chosen].tolist()]))
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        at, sim = np.r_[at, new], np.r_[sim, x[new] @ q]
        todo = np.r_[todo, np.ones(len(new), bool)]
        order = np.argsort(-sim, kind="stable")
        keep = max(beam, int((sim >= least).sum()))
        order = order[:keep]
        at, sim, todo = at[order], sim[order], todo[order]
    return at[sim >= least]


def _assign(nodes: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
    """Staged (node, vector, weight, shards): the nearest centroids' numbers in order."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                c = shared.value
                sims = _matrix(pdf["vector"]) @ c.T
                take = min(overlap, len(c))
                top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                yield pdf.assign(shards=np.sort(top, axis=1).tolist())

    kind = nodes.schema["vector"].dataType.simpleString()
    schema = f"node long, vector {kind}, weight long, shards array<int>"
    return staged(nodes.mapInPandas(run, schema), "vector-shards", 5_000)


def _graph(members: DataFrame) -> DataFrame:
    """Staged (node, neighbours): the united lists of every vector's chunks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids = pdf["node"].to_numpy()
        graph = build_graph(_matrix(pdf["vector"]), int(pdf["shard"][0]))
        return pd.DataFrame({"node": ids, "neighbours": [ids[g].tolist() for g in graph]})

    lists = members.groupBy("shard", "chunk").applyInPandas(run, "node long, neighbours array<long>")
    return staged(
        lists.groupBy("node").agg(
            F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")
        ),
        "vector-graph",
    )


def _search_all(members: DataFrame, graph: DataFrame, least: float, beam: int) -> DataFrame:
    """Staged (node, links, other): links counted here; edges to ``other`` that span all of them.

    A task searches the graph of one chunk for the vectors of one chunk of the same shard. ``other``
    is null where a row only counts.
    """
    rows = members.join(graph, "node")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    as_graph = rows.withColumn("asking", F.explode(every)).select(
        "shard", "asking", F.col("chunk").alias("asked"), F.lit(True).alias("in_graph"), "node",
        "vector", "weight", "shards", "neighbours",
    )
    as_query = members.withColumn("asked", F.explode(every)).select(
        "shard", F.col("chunk").alias("asking"), "asked", F.lit(False).alias("in_graph"), "node",
        "vector", "weight", "shards", F.lit(None).cast("array<bigint>").alias("neighbours"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        own = pdf[pdf["in_graph"]].sort_values("node", ignore_index=True)
        ask = pdf[~pdf["in_graph"]]
        if not len(own) or not len(ask):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        ids, weight = own["node"].to_numpy(), own["weight"].to_numpy()
        x, shards = _matrix(own["vector"]), [set(s) for s in own["shards"]]
        lists = []
        for neighbours in own["neighbours"]:
            n = np.asarray(neighbours, np.int64)
            at = np.minimum(np.searchsorted(ids, n), len(ids) - 1)
            lists.append(at[ids[at] == n])
        mean = x.mean(axis=0)
        start = int((x @ mean).argmax())
        lists = connect(x, lists, start)
        every_id = np.unique(np.r_[ids, ask["node"].to_numpy()])
        group, place = np.arange(len(every_id)), np.searchsorted(every_id, ids)
        out = []
        for node, v, mine in zip(ask["node"], _matrix(ask["vector"]), ask["shards"], strict=True):
            found = search(x, lists, start, v, least, beam)
            found = found[ids[found] != node]
            if len(found):
                here = [k for k in found.tolist() if min(shards[k].intersection(mine)) == shard]
                out.append((node, int(weight[here].sum()), None))
                met = np.unique(group[np.r_[place[found], np.searchsorted(every_id, node)]])
                if len(met) > 1:
                    out.extend((every_id[met[0]], 0, every_id[k]) for k in met[1:].tolist())
                    group[np.isin(group, met)] = met[0]
        node, links, other = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({
            "node": np.array(node, np.int64), "links": np.array(links, np.int64),
            "other": pd.array(other, "Int64"),  # never as floats, which would round
        })

    tasks = as_graph.union(as_query).groupBy("shard", "asking", "asked")
    return staged(tasks.applyInPandas(run, "node long, links long, other long"), "vector-links")


def _audit(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """Mean share of their links that the search found for AUDIT vectors, compared with all; vectors
    without links don't count."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).toPandas()
    if not len(sample):
        return 1.0
    q, ids = _matrix(sample["vector"]), sample["node"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast((q, ids))

    def run(batches):
        q, ids = shared.value
        total = np.zeros(len(ids), np.int64)
        for pdf in batches:
            if len(pdf):
                hit = (q @ _matrix(pdf["vector"]).T >= least) & (ids[:, None] != pdf["node"].to_numpy())
                total += hit @ pdf["weight"].to_numpy()
        yield pd.DataFrame({"node": ids, "links": total})

    exact = nodes.mapInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("e"))
    share = F.least("e", F.coalesce("links", F.lit(0))) / F.col("e")
    mean = exact.where("e > 0").join(found, "node", "left").agg(F.avg(share).alias("share")).first()
    return 1.0 if mean["share"] is None else float(mean["share"])


def _all_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """Staged (node, links, other) from every vector against all of its length, in blocks.

    The exact way where the graph misses too much: every pair of blocks of about CHUNK vectors is one
    task.
    """
    sized = nodes.withColumn("size", F.size("vector"))
    blocks = sized.groupBy("size").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = sized.join(small_side(staged(blocks, "vector-blocks")), "size").withColumn("own", own)
    sent = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own",
        "node", "vector", "weight",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        x, ids, weight = _matrix(pdf["vector"]), pdf["node"].to_numpy(), pdf["weight"].to_numpy()
        left = np.flatnonzero(pdf["own"] == low)
        right = np.flatnonzero(pdf["own"] == high)
        links = np.zeros(len(ids), np.int64)
        group = np.arange(len(ids))
        edges = []
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            hit = (x[rows] @ x[right].T >= least) & (rows[:, None] != right)
            links[rows] += hit @ weight[right]
            if low != high:
                links[right] += hit.T @ weight[rows]
            for r, found in zip(rows.tolist(), hit, strict=True):
                met = np.unique(group[np.r_[right[found], r]])
                if len(met) > 1:
                    edges.extend((int(ids[met[0]]), int(ids[k])) for k in met[1:].tolist())
                    group[np.isin(group, met)] = met[0]
        some = np.flatnonzero(links)
        node = np.r_[ids[some], np.array([e[0] for e in edges], np.int64)]
        other = [None] * len(some) + [e[1] for e in edges]
        return pd.DataFrame({
            "node": node.astype(np.int64), "links": np.r_[links[some], np.zeros(len(edges), np.int64)],
            "other": pd.array(other, "Int64"),
        })

    tasks = sent.groupBy("size", "low", "high")
    return staged(tasks.applyInPandas(run, "node long, links long, other long"), "vector-pairs")


def _graph_links(nodes: DataFrame, count: int, least: float) -> tuple[DataFrame, float]:
    """(node, links, other) of ``count`` vectors of one length by the graph, and the audited recall.

    If the last try misses TARGET, all pairs are compared.
    """
    share = min(1.0, 1.2 * SAMPLE / count)
    sample = (nodes if share == 1.0 else nodes.sample(share, 7)).limit(SAMPLE)
    x = _matrix(sample.orderBy("node").select("vector").toPandas()["vector"])
    for overlap, beam in TRIES:
        wanted = -(-count * overlap // SHARD)
        centers = fit_centroids(x, min(max(1, wanted), CENTROIDS))
        dealt = _assign(nodes, centers, overlap)
        spread = dealt.withColumn("shard", F.explode("shards"))
        chunks = staged(
            spread.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")),
            "vector-chunks",
        )
        members = spread.join(small_side(chunks), "shard").withColumn(
            "chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")
        )
        links = _search_all(members, _graph(members), least, beam)
        found = staged(links.groupBy("node").agg(F.sum("links").alias("links")), "vector-found")
        recall = _audit(nodes, found, least)
        if recall >= TARGET:
            return links, recall
    return _all_pairs(nodes, least), 1.0


def vector_components(
    vectors: DataFrame, least: float = 0.95, vector: str = "embedding", vec_id: str = "vec_id"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``vectors``.

    Vectors link at a cosine of at least ``least``, in double precision, with vectors of their length.
    Null, empty or zero vectors and those with null, NaN or infinite components link with nothing.
    Equal vectors are one node with a weight and link with each other, and rows that repeat an id are
    counted row by row. component_id is the smallest
    vec_id of the group, the own one without links; null ids are never the smallest. ``recall`` is
    the audited share of links of a vector, the least over the lengths, which are searched one by
    one. Other columns are not read. An empty table gives no rows.
    """
    column = vectors.schema[vector].dataType
    kind = "float" if column.simpleString() == "array<float>" else "double"
    v = F.col(f"`{vector}`").cast(f"array<{kind}>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("vector"), usable.alias("ok"))
    rows = staged(
        rows.select("vec_id", "vector", F.when(F.col("ok"), F.xxhash64("vector")).alias("node")), "vector-rows"
    )
    nodes = staged(
        rows.where("node is not null").groupBy("node").agg(
            F.first("vector").alias("vector"), F.count("*").alias("weight")
        ),
        "vector-nodes",
    )
    # one row for each length
    sizes = {r["size"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("size")).count().collect()}
    links = vectors.sparkSession.createDataFrame([], "node long, links long, other long")
    recall = 1.0
    for n in sorted(n for n, count in sizes.items() if count > 1):
        more, share = _graph_links(nodes.where(F.size("vector") == n), sizes[n], least)
        links, recall = links.union(more), min(recall, share)
    found = staged(links.groupBy("node").agg(F.sum("links").alias("links")), "vector-all-found")
    groups = components(
        links.where("other is not null")
        .select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(),
        "vector",
    )
    known = (
        rows.select("vec_id", "node")
        .join(nodes.select("node", "weight"), "node", "left")
        .join(found, "node", "left")
        .join(groups, "node", "left")
        .select(
            "vec_id", F.coalesce("component", "node").alias("group"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
        )
    )
    smallest = known.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("low"))
    out = known.join(smallest, "group", "left").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"),
        F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn(
        "recall", F.lit(float(recall))
    )
