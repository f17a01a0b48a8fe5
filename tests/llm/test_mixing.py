"""The mix against sequential brute force on small tables."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from lorekeep.llm import mixing
from lorekeep.llm.mixing import mix, mix_totals, op7_mixing, schedule, source_targets


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_query_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    want = brute_targets(total)
    got = op7_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5
    again = {(r.doc_id, r.taken) for r in op7_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_small_sources_are_capped_and_the_rest_reshared(spark):
    sizes = {"a": 1000, "b": 1, "c": 10, "d": 0, None: 5}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_schedule_is_even_in_every_stretch(spark):
    targets = spark.createDataFrame([(0, 51200), (1, 102400), (2, 153600)], "sid long, words long")
    slots = sorted((r.slot, r.sid, r.block) for r in schedule(targets).collect())
    assert sorted((s, b) for _, s, b in slots) == [(s, b) for s in range(3) for b in range(100 * (s + 1))]
    for cut in (60, 200, 421):
        part = [s for i, s, _ in slots if i < cut]
        assert all(abs(part.count(s) - cut * (s + 1) / 6) <= 3 for s in range(3))


def test_odd_rows(spark):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (3, "x y z", None, 9), (3, "x y z", None, 9), (None, "p q", "a", 9), (5, "w " * 5000, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = [(r.doc_id, r.size, r.taken) for r in mix_totals(docs).collect()]
    assert sorted((i or 0, n) for i, n, _ in got) == [(0, 2), (1, 0), (2, 0), (3, 3), (3, 3), (5, 5000)]
    assert all(t <= 3 * n for _, n, t in got)
    assert mix_totals(docs.limit(0)).count() == 0
    spans = mix(docs).where("slot IS NOT NULL").collect()
    assert all(0 <= r.start and r.start + r.n <= r.size and r.n > 0 for r in spans)


def test_rows_of_one_source_are_spread(spark, monkeypatch):
    """With one source and null ids, neither a bucket nor a key of the join with slots holds more than a few buckets' rows."""
    monkeypatch.setattr(mixing, "BUCKET", 50)
    docs = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    spans = mixing.mix(docs).where("slot IS NULL")
    assert spans.count() == 4_000
    assert spans.groupBy("sid", "bucket").count().agg(F.max("count")).first()[0] < 150
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "(-1 - bucket" in plan
    totals = mixing.mix_totals(docs)
    assert totals.count() == 4_000 and totals.agg(F.sum("taken")).first()[0] == 12_000
