"""Reputation of hosts: levels, frequent hosts, and what labels change."""

import pytest

from tessera.llm import common, url_filter


def table(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")


@pytest.mark.parametrize("often", [1000, 1])
def test_worse_hosts_are_blocked(spark, monkeypatch, often):
    monkeypatch.setattr(common, "OFTEN", often)
    urls = [f"http://h{k % 9}.com/{k}" for k in range(180)] + [f"http://bad.io/{k}" for k in range(60)] + [None, "x", "http://new.bad.io/1"]
    labels = spark.createDataFrame([(k, 1 if k % 10 else 0) for k in range(180)] + [(180 + k, 0 if k % 5 else 1) for k in range(60)], "doc_id long, quality int")
    got = url_filter.url_filter(table(spark, urls), labels).collect()
    assert len(got) == len(urls)
    by = {r.host: r.verdict for r in got}
    assert by["bad.io"] == "block" and {by[f"h{k}.com"] for k in range(9)} == {"allow"} and by[""] == "allow"
    assert {r.verdict for r in url_filter.url_filter(table(spark, urls), labels.filter("quality = 1")).collect()} == {"allow"}


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "u@x.example.com:80": ("example.com", "com"), "10.0.0.1:8": ("10.0.0.1", "[address]"), "[::1]": ("[::1]", "[address]"), "com": ("com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    rows = df.select("host", url_filter.domain_of(df.host, url_filter.SUFFIXES).alias("d"), url_filter.suffix_of(df.host, url_filter.SUFFIXES).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == hosts


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert url_filter.url_filter(table(spark, ["x"]).limit(0), none).count() == 0


@pytest.mark.parametrize("often", [1000, 1, 0])
def test_against_sql(spark, monkeypatch, often):
    """Hosts of every kind, where reputation blocks some and allows others at each level."""
    import duckdb

    monkeypatch.setattr(common, "OFTEN", often)
    hosts = [f"h{k % 7}.com" for k in range(140)] + [f"p{k}.bad.io:80" for k in range(40)] + ["10.0.0.1"] * 30 + ["10.0.0.2:8080"] * 30 + [f"s{k % 5}.x.co.uk" for k in range(50)]
    good = [int(k % 8 > 0) for k in range(140)] + [0] * 40 + [int(k % 6 > 0) for k in range(30)] + [int(k % 6 == 0) for k in range(30)] + [int(k % 3 > 0) for k in range(50)]
    urls = [f"http://{h}/{k}" for k, h in enumerate(hosts)] + ["http://new.bad.io/1", "http://un@10.0.0.2/", "http://other.org/es/1", "http://a.net/de/7", "x", None]
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(good) if k % 11], "doc_id long, quality int")
    pages = table(spark, urls)
    got = {tuple(r) for r in url_filter.url_filter(pages, labels).collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    want = con.sql(url_filter.oracle()).select("page_id, host, path, rule, verdict").fetchall()
    assert len(got) == len(urls) and got == set(want)
    by_method = {(r[1].split(":")[0], r[4]) for r in got if r[3] is None}
    assert {("10.0.0.2", "block"), ("new.bad.io", "block"), ("10.0.0.1", "allow"), ("h0.com", "allow"), ("", "allow")} <= by_method
