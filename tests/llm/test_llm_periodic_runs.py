import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq

from tidegrid.llm import periodic_runs as pr
from tidegrid.llm.queries_periodic_runs import op11_kruskal_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=6, min_exponent=4):
    out, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            part = words[start : at + q]
            shorter = any(all(x == y for x, y in zip(part, part[p:])) for p in range(1, q))
            if len(part) >= max(min_length, min_exponent * q) and not shorter:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_words(rng):
    kinds = rng.choice(["ab", "abc", "abcdefgh"])
    words = [rng.choice(kinds) for _ in range(rng.randrange(30))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice(kinds) for _ in range(rng.randrange(1, 6))]
        words += unit * rng.randrange(1, 8) + [rng.choice(kinds) for _ in range(rng.randrange(4))]
    return [w.encode() for w in words]


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(40)] + [[]]
        for got, words in zip(pr.find_runs(docs, 6, 4), docs, strict=True):
            assert got == brute_runs(words), words
    for length, exponent in ((2, 2), (7, 3), (20, 4)):
        docs = [random_words(rng) for _ in range(300)]
        for got, words in zip(pr.find_runs(docs, length, exponent), docs, strict=True):
            assert got == brute_runs(words, length, exponent), (length, exponent, words)


def test_nested_runs_and_long_runs():
    block = [b"x%d" % i for i in range(50)] + [b"a"] * 6
    for words in (block * 4, [b"a"] * 5000, [b"a", b"b"] * 3000 + [b"a"], block * 5 + [b"x0"]):
        assert pr.find_runs([words], 6, 4) == [brute_runs(words)] != [[]]


def test_query_matches_brute_force(spark):
    want = []
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        words = planted(r["doc_id"], WORD.findall(r["text"] or ""))
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want.append((
            r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapse(words, runs)),
        ))
    assert sum(w[1] for w in want) > 10
    assert sorted(map(tuple, op11_kruskal_runs(spark, SF).collect())) == sorted(want)


def test_rows_without_words_and_clashing_columns(spark, tmp_path):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (None, "a " * 9, "x"), (4, "a\x85a " * 6, None),
        (4, "a\x85a " * 6, None), (5, "b c " * 20_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(docs).collect())
    assert got == [
        (0, [(0, 9, 1)], "a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a\x85a"),
        (4, [(0, 6, 1)], "a\x85a"), (5, [(0, 40_000, 2)], "b c"),
    ]
    assert pr.periodic_runs(docs.where("false")).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    nothing = [r for r in op11_kruskal_runs(spark, str(tmp_path)).collect() if not r.n_runs]
    assert {(r.start, r.length, r.period, r.exponent_milli, r.runs_sha256) for r in nothing} == {(None,) * 4 + (sha(""),)}
