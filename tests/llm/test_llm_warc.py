import hashlib
import random

from tidegrid.llm import warc
from tidegrid.session import staging_path

LONG = "<p>" + "text " * 40
PAGES = [
    (1, "http://B.example.org/x?q#f", LONG), (2, "http://a.example.org/", LONG), (0, None, LONG),
    (3, "http://a.example.org/\r\nx: y", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99),
    (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "v", "y" * 100), (7, "w", "y" * 100),
    (None, "n", LONG), (None, "n", "only without id " * 9), (9, "é", "\r\n\r\nWARC/1.1\r\nÜ\r\n\r\n" * 9),
    *[(k, "http://hot.org/", f"{k % 5} " * 80) for k in range(20, 60)],
]


def want():
    first = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = h in first and i != first[h]
        out.append((
            i if i is not None else -1, len(raw), hashlib.sha256(raw).hexdigest(),
            "revisit" if again else "response", first[h] if again else -1,
        ))
    return sorted(out)


def test_pages_come_back_in_merged_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 10)
    rows = [(*p, "x", 1) for p in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size int")
    index = warc.archive_pages(pages.repartition(3)).collect()
    none = lambda x: -1 if x is None else x
    got = sorted(
        (none(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in index
    )
    assert got == want()
    ordered = sorted(index, key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.captured, none(r.page_id)) for r in ordered]
    assert keys == sorted(keys) and len({r.archive for r in index}) > 3


def test_archives_are_valid_records(spark):
    path = staging_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    found = 0
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect():
        for headers, block, _, length in warc.records(bytes(row.content)):
            found += 1
            assert headers["WARC-Record-ID"].startswith("<urn:uuid:") and length > len(block)
            assert (headers["WARC-Type"] == "revisit") == ("WARC-Refers-To" in headers)
    assert found == len(PAGES)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(8)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        merged = list(warc.LoserTree(runs, lambda x: x))
        assert merged == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://B.Example.org/X?q#f") == "org,example,b)/x?q"
    assert warc.url_key("") == ")/"
