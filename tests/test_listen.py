"""Addresses to listen at, against Python's own rules."""

import random
from urllib.parse import quote

from pyspark.sql import functions as F

from lorekeep.functions.text import listen_url, six_digits


def test_seconds(spark):
    rng = random.Random(1)
    times = [0, 1, 5_990_123, 999_999, 1_000_005, 1_000_125, 1_234_565, 999_999_500, 999_999_499, 1_000_000_000, 1_234_565_000, 123_456_500_000]
    times += [rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(3_000)] + [5 + 10 * rng.randrange(100_000, 999_999) for _ in range(2_000)] + [50 + 100 * rng.randrange(100_000, 999_999) for _ in range(1_000)]
    got = spark.createDataFrame([(t,) for t in times], "t long").select("t", six_digits(F.col("t")).alias("s")).collect()
    assert [(r.t, r.s) for r in got if r.s != f"{r.t / 1000:g}"] == []


def test_names(spark):
    names = ["my ep/1", "a+b*c~d", "è 日本?&=#%", "", "plain-name_1.mp3"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", listen_url("http://h/", F.col("n"), F.lit(5_990_123)).alias("u")).collect()
    assert [r.u for r in got] == [f"http://h/episodes/{quote(n, safe='')}?t=5990.12" for n in names]
