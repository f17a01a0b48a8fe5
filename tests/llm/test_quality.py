"""The classifier on held-out labels, and its site posteriors by hand."""

from pyspark.sql import functions as F

import math
from collections import defaultdict

from lorekeep.llm.quality import BANDS, LOG_ODDS, SHARE, SUPPORT, classify, features, fit, op2_quality_classifier, site_sums


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    most = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) > 0
    got = classify(docs, labels.where(most)).join(labels.where(~most), "doc_id").select("kept", "quality", "toxic").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    toxic = [r.kept for r in got if r.toxic]
    junk = [r.kept for r in got if r.quality == 0]
    print(len(clean), sum(clean) / len(clean), sum(toxic) / len(toxic), sum(junk) / len(junk))
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(toxic) <= 0.15 * len(toxic)  # some 350 toxic documents in four languages to learn from
    assert sum(junk) <= 0.1 * len(junk)


def test_sparse_sites_shrink_toward_the_rest(spark):
    rows = [("a", "x", 0.9)] * 2 + [("b", "x", 0.1)] * 500 + [("b", "y", 0.3)] * 100 + [("c", "x", 0.6)] * 300 + [(None, None, 0.5)]
    found, k = site_sums(spark.createDataFrame(rows, "host string, path string, p double"), 0.2)
    host, path = {}, {}
    for r in found.collect():
        host[r.host_] = (r.hs + k["host"] * k["mean"]) / (r.hn + k["host"])
        path[r.host_, r.path_] = (r.s + k["path"] * host[r.host_]) / (r.n + k["path"])
    mean = (1.8 + 50 + 30 + 180 + 0.5) / 903
    assert abs(k["mean"] - mean) < 1e-9 and mean < host["a"] < 0.9 and abs(host["b"] - 80 / 600) < 0.02
    assert path["b", "x"] < host["b"] < path["b", "y"] and (None, None) in path


def strength(values, mean):
    n = len(values)
    var = sum(v * v for v in values) / n - (sum(values) / n) ** 2
    return max(1.0, min(1e4, mean * (1 - mean) / var - 1)) if n > 1 and var > 0 else 100.0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(3)) == 0).collect()]
    bad = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {d.doc_id: features(d.text) for d in docs}
    counts, sizes = defaultdict(lambda: [0, 0]), [0, 0]
    for d in docs:
        if d.doc_id in bad and not d.held:
            sizes[bad[d.doc_id]] += 1
            for f in seen[d.doc_id]:
                counts[f][bad[d.doc_id]] += 1
    strong = {}
    for f, (good, b) in counts.items():
        odds = math.log((b + 0.5) / (sizes[1] + 1)) - math.log((good + 0.5) / (sizes[0] + 1))
        if b >= max(SUPPORT, SHARE * sizes[1]) and odds >= LOG_ODDS:
            strong[f] = odds
    band = lambda d: sum(math.fsum(strong[f] for f in seen[d.doc_id] if f in strong) > top for top in BANDS)
    hits, sizes = [[0, 0] for _ in range(len(BANDS) + 1)], [0, 0]
    for d in docs:
        if d.doc_id in bad and d.held:
            hits[band(d)][bad[d.doc_id]] += 1
            sizes[bad[d.doc_id]] += 1
    weight, top = [], -math.inf
    for good, b in hits:
        top = max(top, math.log((b + 0.5) / (sizes[1] + 1)) - math.log((good + 0.5) / (sizes[0] + 1)))
        weight.append(top)
    share = (sizes[1] + 1) / (sum(sizes) + 2)
    p = {d.doc_id: 1 / (1 + math.exp(-weight[band(d)]) * (1 - share) / share) for d in docs}
    hosts, paths = defaultdict(list), defaultdict(list)
    for d in docs:
        hosts[d.source].append(p[d.doc_id])
        paths[d.source, d.lang].append(p[d.doc_id])
    mean = sum(p.values()) / len(p)
    kh = strength([sum(v) / len(v) for v in hosts.values()], mean)
    of = {h: (sum(v) + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    m = sum(of[h] for h, _ in paths) / len(paths)
    kp = strength([sum(v) / len(v) - of[h] for (h, _), v in paths.items()], m)
    want = {}
    for d in docs:  # the site without the document
        h, s = hosts[d.source], paths[d.source, d.lang]
        hb = (sum(h) - p[d.doc_id] + kh * mean) / (len(h) - 1 + kh)
        pb = (sum(s) - p[d.doc_id] + kp * hb) / (len(s) - 1 + kp)
        want[d.doc_id] = 1 / (1 + math.exp(-weight[band(d)]) * (1 - pb) / pb)
    got = {r.doc_id: r for r in op2_quality_classifier(spark, sf).collect()}
    assert got.keys() == want.keys() and strong and not all(r.kept for r in got.values())
    for i, r in got.items():
        assert abs(r.p_bad - want[i]) < 1e-6 and r.kept == (want[i] < 0.5)
    assert fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).strong.keys() == strong.keys()


def test_query_and_odd_rows(spark, sf):
    assert op2_quality_classifier(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = [(1, None, None, None, 1), (2, "", "s", "en", 1), (3, "a b", "s", "en", 1), (3, "a b", "s", "en", 1), (None, "x " * 20_000, "t", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int")
    labels = spark.createDataFrame([(1, 0, None), (2, None, 1), (3, 1, 0), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        got = classify(docs, marks).collect()
        assert len(got) == 5 and all(0 < r.p_bad < 1 and r.kept is not None for r in got)
    assert classify(docs.limit(0), labels).count() == 0
