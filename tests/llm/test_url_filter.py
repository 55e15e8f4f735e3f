"""URL verdicts against rules and a list applied one url after the other."""

import re
from collections import Counter

import plain
from pyspark.sql import functions as F
from qsolake.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "https://Org", "https://a.ORG/", "https://example.org/es/1", "https://www.EXAMPLE.org/es", "https://x.example.org/en/1?a=1",
    "https://x.example.org/en/2", "https://notexample.org/es/1", "https://xorg/es/", "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/en/x#y",
    "http://spam-farm.net/en/1", "https://www.spam-farm.net:443/en/1/?utm_source=a&b=2&a=1#x", "https://m.spam-farm.net/en/1.html?a=1&b=2&ref=z", "http://spam-farm.net/en/12",
    "ftp://ads-track.net", "http://ads-track.net/?x", "http://ads-track.net/index.html", "a://b://c.net/d", "http://cheap-pills.a.com/fr/1", "http://k.net/" + "p" * 50_000, "http://x.net\n/a",
]


def parts(url: str | None) -> tuple[str, str, str]:
    rest = (url or "").partition("://")[2]
    at = re.match("[^/?#]*", rest).end()
    return plain.lower(rest[:at]), re.match("[^?#]*", rest[at:])[0], rest.partition("#")[0].partition("?")[2]


def canonical(url: str | None) -> str | None:
    host, path, given = parts(url)
    if not host:
        return None
    host = re.sub(":(80|443)$", "", re.sub(r"^(www|m)\.", "", host))
    path = re.sub(r"(/|/index\.html?|\.html?)\Z", "", path)
    kept = sorted(x for x in given.split("&") if x and not re.match("utm_|ref(=|$)|fbclid(=|$)|gclid(=|$)", x))
    return host + path + ("?" + "&".join(kept) if kept else "")


def expected(urls: list, listed: list) -> Counter:
    bad = {canonical(u) for u in listed} - {None}
    out = Counter()
    for u in urls:
        host, path, _ = parts(u)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        out[u, host, path, best and best.name, best.verdict if best else "block" if canonical(u) in bad else "allow"] += 1
    return out


LISTED = ["http://spam-farm.net/en/1?b=2&a=1", "https://ads-track.net", "https://ads-track.net/", None, "", "http://cheap-pills.a.com/fr/1", "http://k.net/" + "p" * 50_000]


def made(spark, urls, listed, **options) -> Counter:
    pages = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", "'x' as host", "1 as _key", "2 as _block", "'z' as verdict", "3 as _w0")
    keys = url_filter.list_of(spark.createDataFrame([(u,) for u in listed], "url string"))
    judged = url_filter.url_filter(pages, keys, **options)
    assert judged.columns == ["url", "_key", "_block", "_w0", "host", "path", "rule", "verdict"]
    return Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in judged.collect())


def test_awkward_urls(spark):
    urls = URLS + URLS[:3] + URLS[-4:]
    want = expected(urls, LISTED)
    assert sum(k[-1] == "block" for k in want) == 8
    assert made(spark, urls, LISTED) == want


def test_blocks_that_are_not_sent(spark):
    assert made(spark, URLS, LISTED, sent_blocks=0) == expected(URLS, LISTED)


def test_false_positives_go(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 0.01)
    urls = [f"http://h{i}.net/{i}" for i in range(3000)]
    keys = url_filter.list_of(spark.createDataFrame([(u,) for u in urls[:600]], "url string"))
    keyed = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("_key", url_filter.canonical(F.col("url")))
    assert url_filter.possible(keyed, keys).where("_possible").count() > 600
    assert made(spark, urls, urls[:600]) == expected(urls, urls[:600])


def test_few_pass_falsely_and_none_is_missed(spark):
    keys = url_filter.list_of(spark.range(20_000).selectExpr("concat('http://h', id % 100, '.net/', id) url"))
    keyed = spark.range(100_000).selectExpr("concat('http://h', id % 100, '.net/', id) url", "id").withColumn("_key", url_filter.canonical(F.col("url")))
    passed = {r.id for r in url_filter.possible(keyed, keys).where("_possible").collect()}
    assert set(range(20_000)) <= passed and len(passed) < 20_400


def test_empty_tables(spark):
    assert made(spark, URLS, []) == expected(URLS, []) and not made(spark, [], LISTED)


def test_rules_are_a_parameter(spark):
    rules = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "net", "/"))
    judged = url_filter.url_filter(spark.createDataFrame([("http://a.net/x",)], "url string"), url_filter.list_of(spark.createDataFrame([], "url string")), rules=rules)
    assert [(r.rule, r.verdict) for r in judged.collect()] == [("net/", "block")]
