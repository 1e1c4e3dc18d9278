import pytest

from epiweave.llm import queries
from epiweave.llm import url_filter as U

URLS = [
    (1, "http://WWW.Example.com/en/1?x=/es/", "a"),
    (2, "https://m.example.com/en/2#top", "a"),
    (3, "https://example.com/fr/", "b"),
    (4, "https://example.com", None),
    (5, "http://a.net/es/1", None),
    (6, "http://net/fr/", None),
    (7, "http://badnet/fr/", None),
    (8, "http://spam.org/x/", None),
    (9, "http://www.spam.org/x?y", None),
    (10, "http://spam.org/x/y", None),
    (11, None, None),
    (12, "no scheme/en/", None),
    (13, "http://", None),
    (14, "http:///en/", None),
    (1, "http://WWW.Example.com/en/1?x=/es/", "a"),
    (15, "http://" + "a." * 5000 + "net/es/" + "x/" * 20000, None),
    (16, "http://net/ES/", None),
    (17, "http://x.com?://b.net/es/", None),
]
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block"), ("", "/en/", "block"),
]
LISTED = [("http://spam.org/x",), ("http://spam.org/x/",), (None,)]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = rest
    for mark in "?#":
        head = head.split(mark, 1)[0]
    slash = head.find("/")
    host, path = (head, "") if slash < 0 else (head[:slash], head[slash:])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    listed = host.removeprefix("www.") + path.rstrip("/") == "spam.org/x"
    return host, path, None, "block" if listed else "allow"


@pytest.fixture(scope="module")
def judged(spark):
    urls = spark.createDataFrame(URLS, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return U.judge_urls(urls, rules, spark.createDataFrame(LISTED, "url string"))


def test_verdicts_equal_brute_force(judged):
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged.collect())
    assert [g[:3] for g in got] == [(i, *brute(u)[:2]) for i, u, _ in sorted(URLS, key=lambda r: r[0])]
    assert {g[0]: g[1:] for g in got} == {i: brute(u) for i, u, _ in URLS}


def test_overfull_filter_changes_nothing(spark, judged, monkeypatch):
    monkeypatch.setattr(U, "BLOCKS", 1)
    urls = spark.createDataFrame(URLS, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    many = spark.range(3000).selectExpr("concat('http://other.org/', id) AS url")
    again = U.judge_urls(urls, rules, spark.createDataFrame(LISTED, "url string").union(many))
    assert sorted(map(str, again.collect())) == sorted(map(str, judged.collect()))


def test_empty_tables(spark):
    urls = spark.createDataFrame(URLS, "page_id long, url string, host string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([], "url string")
    assert {(r.rule, r.verdict) for r in U.judge_urls(urls, rules, listed).collect()} == {(None, "allow")}
    assert U.judge_urls(urls.limit(0), rules, listed).count() == 0


def test_pages_of_every_planted_label_are_listed(spark, tmp_path):
    labels = ["spam-farm", "casino-win", "ads-track", "free-bets", "cheap-pills", "adult-x"]
    pages = [(i, f"http://www.{label}.example.org/en/{i}", "") for i, label in enumerate([*labels, "blog", "not-adult-x"])]
    pages += [(i + 10, f"http://{label}.example.com/x", "") for i, label in enumerate(labels)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in queries.QUERIES["op2_url_filters_planted"](spark, str(tmp_path)).collect()}
    assert {i for i, r in found.items() if r.rule is None and r.verdict == "block"} == set(range(6))
    assert all(r.verdict == "allow" for i, r in found.items() if i >= 6)
