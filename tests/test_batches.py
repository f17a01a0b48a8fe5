"""Batches made in parallel are those of the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import batches


def _sequential(sizes, cap):
    batch, used, out = 0, 0, []
    for s in sizes:
        if used + s > cap:
            batch, used = batch + 1, 0
        used += s
        out.append(batch)
    return out


def test_sequential_rule(spark):
    rng, rows, want = random.Random(4), [], {}
    for g, (n, low, cap) in {"a": (3_000, 1, 97), "b": (400, 60, 97), "c": (50, 97, 97), "d": (1, 5, 97), None: (700, 1, 97)}.items():
        sizes = [rng.randint(low, cap if rng.random() < 0.2 else max(low, cap // 6)) for _ in range(n)]
        rows += [(g, i * 3, s) for i, s in enumerate(sizes)]
        want |= {(g, i * 3): b for i, b in enumerate(_sequential(sizes, cap))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream string, at int, bytes int")
    assert {(r.stream, r.at): r.batch for r in batches.pack_batches(df, "stream", ["at"], "bytes", 97, span=2).collect()} == want
    assert batches.pack_batches(df.where("false"), "stream", ["at"], "bytes", 97).count() == 0
    for bad in (0, 98, None):
        with pytest.raises(Exception, match="empty or larger"):
            batches.pack_batches(df.limit(5).withColumn("bytes", F.lit(bad).cast("int")), "stream", ["at"], "bytes", 97)


def test_stream_that_ends_in_a_batch_of_the_block_before(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([10, 9, 2, 1])], "stream string, at int, bytes int")
    got = batches.pack_batches(df, "stream", ["at"], "bytes", 10, span=2).orderBy("at").collect()
    assert [(r.at, r.batch) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 2)]


def test_one_stream_of_a_million(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("stream"), F.col("id").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(90_000)) + 1).alias("bytes"))
    got = batches.pack_batches(df, "stream", ["at"], "bytes", 1_000_000).orderBy("at").toPandas()["batch"].tolist()
    assert got == _sequential(df.orderBy("at").toPandas()["bytes"].tolist(), 1_000_000)
