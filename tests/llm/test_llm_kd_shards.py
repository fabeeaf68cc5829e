import random
import zlib

import pytest

from tidegrid.llm import kd_shards as kd

RNG = random.Random(6)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def check(docs, rows, shards, slack):
    want = sorted(((i or -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    share = sum(r.size for r in rows) / shards
    assert all(abs(sum(r.size for r in p) - share) <= slack for p in by.values())


@pytest.mark.parametrize("shards", [8, 3])
def test_shards_have_nearly_equal_bytes(spark, monkeypatch, shards):
    monkeypatch.setattr(kd, "SLOT_ROWS", 50)
    docs = [(k, "é" * RNG.randrange(200), RNG.choice(["hot"] * 5 + ["a", "b", None]), "s") for k in range(600)]
    docs += [(None, None, None, None), (5, "", "", ""), (5, "", "", "")]
    rows = kd.kd_shards(frame(spark, docs), shards).collect()
    check(docs, rows, shards, 800)


def test_equal_rows_are_divided(spark):
    docs = [(1, "the same", "s", "x")] * 400 + [(2, "other", "t", "x")] * 200
    check(docs, kd.kd_shards(frame(spark, docs), 4).collect(), 4, 40)


def test_target_bytes_missing_dimensions_and_no_rows(spark):
    docs = spark.createDataFrame([(k, "x" * 99) for k in range(100)], "doc_id long, text string")
    rows = kd.kd_shards(docs, target_bytes=2_500, dimensions=("lang",)).collect()
    assert {r.shard for r in rows} == {0, 1, 2, 3}
    assert kd.kd_shards(docs.where("false"), 8).count() == 0
