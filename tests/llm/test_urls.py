from __future__ import annotations

import duckdb
import pytest

from lakeproof.llm import urls
from tools.check import canonical

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.net/x", "http://NET/x", "http://xnet/", "http://example.net/en/1", "http://b.example.net/en/",
    "http://b.example.net/en", "http://b.example.net/EN/", "http://notexample.net/en/", "https://www.example.com/de/?q=/en/", "https://example.com/fr/#/de/", "http://h.org/fr/a?b://c/d",
    "http://h.org?x=/fr/", "http://h.org#f", "://org/fr/", "a://b://net/", "http://..net/", "http://net./", "http://é\U0001f600ÀB.org/漢字/\U0001f600", "http://a\nb.net/\n", "http://a.net:80/",
    "http://casino-win.example.com/en/1", "http://www.daily-news.example.com/en/1", "http://x/" + "long/" * 20_000, "http://" + "a." * 5_000 + "net/", "http://x.com/ab", "HTTP://U@Example.COM/de/",
]
PAIRS = [*enumerate(URLS), (3, URLS[3]), (3, "http://other.net/"), (None, URLS[6]), (None, URLS[6])]


def expected(page, url, rules=urls.RULES):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = []
    for verdict, rule in rules:
        rule_host, _, begin = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + begin):
            fitting.append((len(rule), len(rule_host), rule, verdict))
    bias, *parts = urls.fit()
    margin = bias
    for part, weights in zip((host, path), parts, strict=True):
        text, total, n = f"^{part}$", 0, 0
        for i in range(len(text) - 3):
            bucket = sum(ord(c) * 257 ** (3 - j) for j, c in enumerate(text[i : i + 4])) % urls.BUCKETS
            total, n = total + weights[bucket], n + 1
        margin += total // n if n else 0
    _, _, rule, verdict = max(fitting, default=(0, 0, None, "block" if margin >= 0 else "allow"))
    return page, host, path, rule, verdict, margin


@pytest.fixture(scope="module")
def pages(spark):
    names = "page_id bigint, url string, host string, rule string, `a.b` string, verdict int, margin string"
    return spark.createDataFrame([(i, u, "h", "r", "odd", 1, "m") for i, u in PAIRS], names)


def test_report(spark, pages):
    got = urls.report(pages)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, u) for i, u in PAIRS), key=str)
    assert urls.report(pages.limit(0)).collect() == []


def test_sql(spark, pages):
    got = urls.report(pages.filter("page_id is not null")).toPandas()
    with duckdb.connect() as db:
        frame = pages.filter("page_id is not null").select("page_id", "url").toPandas()
        db.register("pages", frame)
        assert canonical(got) == canonical(db.sql(urls.sql()).df())


def test_rules_of_many_depths(spark, pages):
    rules = [("allow", "a.net/"), ("block", "a.net/x"), ("block", "net/x"), ("block", "b.example.net/e"), ("allow", "b.example.net/en"), ("block", "casino-win.example.com/"), ("allow", "com/")]
    got = urls.report(pages, rules=rules).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, u, rules) for i, u in PAIRS), key=str)
    assert {r.rule for r in urls.report(pages, rules=()).collect()} == {None}
    with pytest.raises(ValueError):
        urls.report(pages, rules=[("block", "net")])


def test_keep_leaves_columns_and_rows(spark, pages):
    got = urls.keep(pages)
    assert got.columns == pages.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(((i, u) for i, u in PAIRS if expected(i, u)[4] == "allow"), key=str)


def test_main_path_is_native_and_without_shuffle(pages):
    plan = urls.report(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange hash", "CartesianProduct", "NestedLoop"))
    assert "BroadcastHashJoin" in plan


def test_model():
    bias, of_host, of_path = urls.fit()

    def margin(url):
        return expected(0, url, rules=())[5]

    assert all((margin(url) >= 0) == bool(label) for url, label in urls.LABELLED)
    bad = ["http://casino-palace.example.com/en/1", "https://adult-chat.example.org/en/44", "http://m.ads-track.example.org/fr/8", "http://www.spam-farm.example.com/en/5"]
    good = ["http://www.evening-news.example.com/en/1", "https://university.example.org/en/44", "http://m.railway-notes.example.org/fr/8", "http://www.astronomy.example.com/en/5"]
    assert sum(margin(u) >= 0 for u in bad) >= 3 and sum(margin(u) < 0 for u in good) >= 3
    assert len(of_host) == len(of_path) == urls.BUCKETS
    with pytest.raises(ValueError):
        urls.fit(())
