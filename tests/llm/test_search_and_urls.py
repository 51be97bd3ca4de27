import math

import pytest
from pyspark.sql import functions as F

from vellum.llm import topk_search, url_filter

INF = float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [((i * 37 + 11 * d) % 19 - 9) / 7 for d in range(6)]) for i in range(0, 230)]
    rows += [(300, None), (301, [1.0, None]), (400, [1.0, math.nan]), (500, [INF, 1.0]), (600, []), (700, [0.5]), (800, [0.0] * 6), (801, rows[3][1]), (802, rows[3][1]), (900, [2.0] * 9)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("score", F.lit(2))


def brute(df, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    vec = {r["vec_id"]: [math.floor(1024 * x) for x in r["embedding"]] for r in df.collect() if ok(r["embedding"])}
    out = set()
    for q in vec:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(vec[q], c, strict=False)), i) for i, c in vec.items() if i != q)[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(4096, 1024), (50, 2)])
def test_top_k_matches_brute_force(vectors, monkeypatch, blocks):
    monkeypatch.setattr(topk_search, "CAND_BLOCK", blocks[0])
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks[1])
    rows = vectors.withColumn("vector", topk_search.quantise("embedding"))
    got = {tuple(r) for r in topk_search.top_k(rows, rows.filter("vec_id % 100 = 0"), 10).collect()}
    assert got == brute(vectors, 10)


def test_few_candidates_repeated_queries_and_no_rows(vectors):
    few = vectors.filter("vec_id IN (0, 1, 2)").withColumn("vector", topk_search.quantise("embedding"))
    q = few.filter("vec_id = 0")
    got = topk_search.top_k(few, q.unionByName(q), 10).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == sorted((k, i) for _, k, i, _ in brute(vectors.filter("vec_id IN (0, 1, 2)"), 10))
    assert topk_search.top_k(few.filter("false"), q, 10).count() == 0
    assert topk_search.top_k(few, q.filter("false"), 10).count() == 0


BLOCKED = ("ads-track.example.com", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net")
URLS = [(0, None), (1, ""), (2, "no scheme/path"), (3, "https://EXAMPLE.org/es/x"), (4, "http://a.example.org/en/12?q=1"), (5, "https://example.org"),
        (6, "https://x.com/fr/1#a"), (7, "https://x.com/de/"), (8, "https://com/de/y"), (9, "https://notorg/"), (10, "ftp://ADS-track.example.com:80/x"),
        (11, "https://m.ads-track.example.com/x"), (12, "https://bads-track.example.com/x"), (13, "https://ok.net/bad/page?x=1"), (14, "https://ok.net/bad/page/2"),
        (15, "https://casino-win.example.net?u=http://b.org/"), (16, "https://spam-farm.example.org/z"), (17, "a://b://c.org/d"), (18, "https://É.com/ü"), (19, "https://x..y/" + "p" * 9000),
        (19, "https://x..y/q\nr"), (None, "https://free-bets.example.net/")]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("entry", F.lit("e"))
    blocked = spark.createDataFrame([*[(b,) for b in BLOCKED], ("ok.net/bad/page",), (None,), ("",), (BLOCKED[0],)], "entry string")
    rows = url_filter.judge(pages, blocked).collect()
    assert len(rows) == len(URLS)
    got = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in rows if r["page_id"] != 19}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("example.org", "/es/x", "example.org/es/", "block"),
        4: ("a.example.org", "/en/12", "example.org/en/1", "block"), 5: ("example.org", "", None, "allow"), 6: ("x.com", "/fr/1", "com/fr/", "allow"),
        7: ("x.com", "/de/", "com/de/", "block"), 8: ("com", "/de/y", "com/de/", "block"), 9: ("notorg", "/", None, "allow"),
        10: ("ads-track.example.com:80", "/x", None, "allow"), 11: ("m.ads-track.example.com", "/x", None, "block"), 12: ("bads-track.example.com", "/x", None, "allow"),
        13: ("ok.net", "/bad/page", None, "block"), 14: ("ok.net", "/bad/page", None, "allow"), 15: ("casino-win.example.net", "", None, "block"),
        16: ("spam-farm.example.org", "/z", "org/", "allow"), 17: ("b:", "//c.org/d", None, "allow"), 18: ("É.com", "/ü", None, "allow"),
        None: ("free-bets.example.net", "/", None, "block")}
    assert url_filter.judge(pages.filter("false"), blocked).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.filter("page_id = 15"), blocked.filter("false")).collect()} == {"allow"}


def test_probe_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_ROWS", 100)
    stored = spark.range(0, 3000, 3).selectExpr("concat('host', id) AS entry")
    wanted = spark.range(0, 1000).selectExpr("concat('host', id % 500) AS entry")
    assert {r["entry"] for r in url_filter.probe(wanted, stored).collect()} == {f"host{i}" for i in range(0, 500, 3)}


def test_listed_names_are_blocked_under_every_domain(spark):
    from tests.conftest import SF_SMALL
    urls = ["https://m.casino-win.example.com/x", "http://free-bets.co.uk/", "http://adult-x.test:8080/a", "http://my-adult-x.test/", "http://a.b.org/casino-win.example.com", "http://casino-win"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.variants(url_filter.NAMES, pages)
    assert listed.count() == listed.distinct().count() >= 6 * 10
    got = {r["page_id"]: r["listed"] for r in url_filter.judge(pages, listed).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}
    pages = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/pages.parquet")
    found = url_filter.judge(pages, url_filter.variants(url_filter.NAMES, pages)).filter("listed").count()
    assert found == pages.filter(F.col("url").rlike("://([^/?#]*[.])?(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)[.]")).count() == 136
