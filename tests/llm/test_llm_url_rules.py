import random

import pytest

from tidegrid.llm import url_rules
from tidegrid.llm.url_rules import RULE_SCHEMA, judge_urls

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "/en/", "allow"),
    ("a.example.org", "/en/12", "allow"), ("Net", "", "block"), ("net", "/x", "allow"),
    ("net", "/x", "block"), ("net", "/x/y/z", "allow"),
]
URLS = [
    None, "", "example.org/es/", "http://", "http:///es/", "http://example.org", "http://example.org/",
    "https://EXAMPLE.ORG/es/a?b#c", "http://b.example.org/es/", "http://example.org/en/1",
    "http://a.example.org/en/123", "http://myexample.org/es/", "http://example.com/fr/x",
    "http://example.com?x=/de/", "http://x.com/de/#f", "ftp://Ünï.net/x/y/z/w", "http://net/x/y",
    "x://net#a", "http://e.net:80/x", "http://u@e.net/x", "http://a..org/", "://org/",
    "http://net/x\U0010ffff\U0010ffff", "http://h.org/a://b.com/de/",
]


def judge(url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fits = [
        (len(h + p), len(h), v, h.lower() + p) for h, p, v in RULES
        if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fits) if fits else (0, 0, default, None)
    return host, path, best[3], best[2]


@pytest.mark.parametrize("slice_urls", [3, 20_000])
def test_urls_match_brute_force(spark, monkeypatch, slice_urls):
    monkeypatch.setattr(url_rules, "SLICE_URLS", slice_urls)
    rng = random.Random(1)
    urls = URLS + [
        f"http://{rng.choice(['', 'a.', 'b.a.'])}{rng.choice(['example.org', 'net', 'com', 'x.com'])}"
        f"/{rng.choice(['es', 'en', 'de', 'fr', 'x'])}/{rng.randrange(40)}" for _ in range(80)
    ] * 2
    pages = spark.createDataFrame(
        [(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string"
    )
    rows = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA), default="block").collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], "block"), urls[r.page_id]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    assert judge_urls(pages.where("false"), rules).count() == 0
    row = judge_urls(pages, rules.where("false")).first()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.org", "/", None, "allow")


def test_clashing_columns_are_kept(spark):
    pages = spark.createDataFrame(
        [("http://a.org/x", "p", "q", "r", "s")], "url string, url_host string, url_path string, slice string, labels string"
    )
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    row = judge_urls(pages, rules).first()
    assert (row.url_host, row.url_path, row.slice, row.labels, row.verdict) == ("p", "q", "r", "s", "block")
