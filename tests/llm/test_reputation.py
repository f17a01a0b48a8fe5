"""URL rules, and host reputation against a plain computation."""

import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lorekeep.llm.reputation import STRONGEST, URLS, WEAKEST, domain_of, host_and_path, judge, op12_url_filter

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def strength(nodes):
    known = [(k, n, m) for k, n, m in nodes if n]
    of = sum((n - 1) * m * (1 - m) for _, n, m in known)
    if of <= 0:
        return STRONGEST
    over = sum(n * (k / n - m) ** 2 - m * (1 - m) for k, n, m in known)
    return min(max(1 / max(over / of, 1e-12) - 1, WEAKEST), STRONGEST)


def brute_bounds(outcomes, spread=2.0):
    """outcomes: (suffix, domain, host, bad or None)."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for s, d, h, bad in outcomes:
        for c, key in zip(counts, ((s,), (s, d), (s, d, h)), strict=True):
            c[key][0] += bad or 0
            c[key][1] += bad is not None
    total = [sum(v[i] for v in counts[0].values()) for i in (0, 1)]
    prior = {key: (total[0] - k + 0.5) / (total[1] - n + 1) for key, (k, n) in counts[0].items()}
    for up, own in ((counts[0], counts[1]), (counts[1], counts[2])):
        w = strength([(*v, prior[key]) for key, v in up.items()])
        prior = {key: (w * prior[key[:-1]] + up[key[:-1]][0] - k) / (w + up[key[:-1]][1] - n) for key, (k, n) in own.items()}
    w, out = strength([(*v, prior[key]) for key, v in counts[2].items()]), {}
    for key, (k, n) in counts[2].items():
        a, b = w * prior[key] + k, w * (1 - prior[key]) + n - k
        out[key[2]] = a / (a + b) - spread * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return out


def test_bounds_equal_the_plain_computation(spark):
    rng = random.Random(3)
    pages, labels, outcomes = [], [], []
    for i in range(900):
        site = rng.choice(["a", "b", "c", "dd"])
        host = f"{rng.choice(['w', 'x', 'y'])}.{site}.{rng.choice(['org', 'net', 'co.uk'])}"
        suffix, domain = host.split(".", 2)[2], host.split(".", 1)[1]
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.9 if site == "dd" else 0.1))
        pages.append((i, f"http://{host}/p/{i}", None))
        if bad is not None:
            labels.append((i, 1 - bad, 0))
        outcomes.append((suffix, domain, host, bad))
    got = judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), rules=()).collect()
    want = brute_bounds(outcomes)
    assert {(r.host, r.verdict) for r in got} == {(h, "block" if b >= 0.5 else "allow") for h, b in want.items()}
    assert {r.verdict for r in got} == {"allow", "block"} and len(got) == 900


def test_sparse_hosts_lean_on_their_domain(spark):
    """Three bad pages condemn a host of a bad domain, not one of a good domain."""
    pages, labels = [], []
    for site, hosts, bad in (("bad.org", 12, 1), ("good.org", 12, 0)):
        for h in range(hosts):
            for _ in range(20):
                pages.append((len(pages), f"https://h{h}.{site}/", ""))
                labels.append((len(labels), 1 - bad, 0))
    for site in ("bad.org", "good.org"):
        for _ in range(3):
            pages.append((len(pages), f"https://new.{site}/", ""))
            labels.append((len(labels), 0, 0))
    got = {r.host: r.verdict for r in judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), rules=()).collect()}
    assert got["new.bad.org"] == "block" and got["new.good.org"] == "allow" and got["h3.bad.org"] == "block" and got["h3.good.org"] == "allow"


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://www.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://x.net/fr/a://b", "x.net", "/fr/a://b", "net/fr/", "block"),
        ("https://x.net/de/", "x.net", "/de/", None, "allow"),
        ("https://x.com", "x.com", "", None, "allow"),
        ("https://x.com?/en/", "x.com", "", None, "allow"),
        ("x.com/en/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a\n://h.net/es/\n", "h.net", "/es/\n", "net/es/", "block"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None)], PAGES)
    got = judge(pages, spark.createDataFrame([], LABELS)).first()
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.example.org", "example.org", "org", "10.1.2.3:80", "u@a.org:8080"]
    suffix, domain = domain_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", suffix.alias("s"), domain.alias("d")).collect()
    assert [(r.s, r.d) for r in got] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("org", "example.org"), ("org", "example.org"), ("org", "org"), ("", "10.1.2.3"), ("org", "a.org")]


def test_odd_rows(spark):
    rows = [(None, "http://spam.org/", ""), (1, "http://a.org/", ""), (1, "http://a.org/", ""), (2, None, None), (3, "", "x"), (4, "http://" + "a" * 100_000 + ".org/", "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'y' AS verdict", "1 AS bad", "2 AS n")
    labels = spark.createDataFrame([(None, 0, 1), (1, None, None), (1, 0, None), (1, 1, 0), (9, 0, 0)], LABELS).selectExpr("*", "'z' AS url")
    got = judge(pages, labels).collect()
    assert len(got) == 6 and sorted((r.host_labelled, r.host_bad) for r in got if r.host == "a.org") == [(2, 2), (2, 2)]
    assert judge(pages, labels.where("false")).count() == 6
    assert judge(pages.where("false"), labels).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = op12_url_filter(spark, sf)
    want = con.sql(URLS)
    names = want.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, map(tuple, got.select(names).collect()))) == sorted(map(key, want.fetchall()))


def test_host_and_path_are_columns(spark):
    host, path = host_and_path(F.col("u"))
    assert tuple(spark.range(1).selectExpr("'A://B/c?d' AS u").select(host, path).first()) == ("b", "/c")
