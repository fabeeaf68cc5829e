import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidegrid.llm import substring_dedup as sd
from tidegrid.llm.queries_substring_dedup import op12_recompression
from tidegrid.llm.recompression import levels, mix

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(words, removed, kept) of rows (id, text) in reading order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = set()
        for p in range(len(words) - window + 1):
            part = tuple(words[p : p + window])
            if part in seen:
                gone.update(range(p, p + window))
            seen.add(part)
        out[k] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [4_000_000, 3_000])
def test_query_matches_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(sd, "CHUNK_BYTES", chunk_bytes)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want = [(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in zip(rows, brute(rows, 20))]
    assert sum(w[2] > 0 for w in want) > 10
    assert sorted(map(tuple, op12_recompression(spark, SF).collect())) == sorted(want)


def random_docs(rng, count):
    passages = [[rng.choice("abcdefghij") for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    passages += [["a"] * 50, ["a", "b"] * 30, list("abc") * 15]
    docs = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(5)):
            part = list(rng.choice(passages))
            at = rng.randrange(len(part))
            words += part[at:] if rng.random() < 0.5 else part
            if words and rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice("abcxyz")
            words += [rng.choice("abcdefghijklm") for _ in range(rng.randrange(8))]
        docs.append(" ".join(words))
    return docs


@pytest.mark.parametrize("window, rounds", [(20, None), (20, 9), (7, None), (1, None), (30, 2)])
def test_texts_match_brute_force(spark, tmp_path, monkeypatch, window, rounds):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 500)
    rng = random.Random(window)
    rows = [(rng.randrange(100), t) for t in random_docs(rng, 120)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sd.drop_repeats(spark.read.parquet(path), window, rounds=rounds).collect()
    want = [(i, t, *x) for (i, t), x in zip(rows, brute(rows, window))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_symbols_are_decided_by_the_words_named():
    rng = np.random.default_rng(5)
    for _ in range(40):
        flat = rng.integers(1, 4, 400)
        flat[rng.integers(0, 400, 6)] = 0
        seen = {}
        for turn, s in enumerate(levels(mix(flat.astype(np.uint64)), flat == 0, 8)):
            for k in range(len(s)):
                x, y = int(s.left[k]), int(s.right[k])
                if s.wall[k] or x < 0 or y > len(flat) or (flat[x:y] == 0).any():
                    continue
                # the same words anywhere hold the same symbol at the same place
                about = (int(s.lo[k]) - x, int(s.hi[k]) - x, int(s.name[k]))
                seen.setdefault((turn, tuple(flat[x:y])), {}).setdefault(about, []).append(x)
        for (turn, part), found in seen.items():
            places = {p for ps in found.values() for p in ps}
            assert all(set(ps) == places for ps in found.values()), (turn, part)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [
        (1, None, 1, "x"), (2, "", 1, "x"), (3, " \n", 1, "x"), (None, long, 1, "x"), (4, long, 1, "x"),
        (4, long, 2, "x"), (5, "short text", 3, None), (6, "v " * 30_000, 3, "x"),
    ]
    path = f"{tmp_path}/docs"
    names = "doc_id long, text string, chunk int, kept string"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted(sd.drop_repeats(docs).collect(), key=lambda r: (r.doc_id or 9, r.chunk))
    assert got[0].__fields__ == ["doc_id", "text", "chunk", "n_words", "n_removed", "kept"]
    assert [(r.doc_id, r.chunk, r.n_words, r.n_removed) for r in got] == [
        (1, 1, 0, 0), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 30, 0), (4, 2, 30, 30), (5, 3, 2, 0),
        (6, 3, 30_000, 29_999), (None, 1, 30, 30),
    ]
    assert [r.kept for r in got] == ["", "", "", long, "", "short text", "v", ""]
    assert sd.drop_repeats(docs.where("false")).count() == 0
