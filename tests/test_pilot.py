"""A pilot is what the sequential rule chooses, or a fault."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import pilot


def _sequential(chunks, split, total, hard):
    out = set()
    for name in sorted(set(split.values())):
        episodes = sorted(e for e in split if split[e] == name)
        for i, e in enumerate(episodes):
            quota, few = total // len(episodes) + (i < total % len(episodes)), hard // len(episodes) + (i < hard % len(episodes))
            own = sorted((c for c in chunks if c[0] == e), key=lambda c: (pilot.DIFFICULTY.index(c[3]), c[2], c[1]))
            out |= {(name, c[1], "difficult", c[3]) for c in own[:few]}
            rest = sorted(own[few:], key=lambda c: (c[2], c[1]))
            plain = [c for c in rest if c[3] == pilot.UNTAGGED]
            rest, count = plain if len(plain) >= quota - few else rest, quota - few
            out |= {(name, rest[(2 * j + 1) * len(rest) // (2 * count)][1], "representative", "temporal_spread") for j in range(count)}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    split = {f"e{i}": "development" if i < 4 else "held_out" for i in range(11)}
    chunks = [(e, f"{e}-{n}", rng.randrange(40) * 1000, pilot.DIFFICULTY[-1] if rng.random() < (0.9 if int(e[1:]) % 2 else 0.1) else rng.choice(pilot.DIFFICULTY)) for e in split for n in range(rng.randint(11, 60))]
    return chunks, split, spark.createDataFrame(chunks, "episode string, chunk_id string, start_ms long, difficulty string"), spark.createDataFrame(list(split.items()), "episode string, partition string")


def test_sequential_rule(corpus):
    chunks, split, c, s = corpus
    for total, hard in ((40, 10), (13, 13), (21, 0)):
        got = pilot.freeze_pilot(c, s, total, hard).collect()
        assert {(r.partition, r.chunk_id, r.category, r.reason) for r in got} == _sequential(chunks, split, total, hard)
        assert len(got) == 2 * total
    row = {r.partition: r for r in pilot.pilot_coverage(pilot.freeze_pilot(c, s), c.withColumn("degraded", F.col("difficulty").contains("degraded")), s, ["degraded"]).collect()}
    assert row["held_out"].chunks == 40 and row["held_out"].difficult == 10 and row["held_out"].episodes == 7


def test_faults(spark, corpus):
    _, _, c, s = corpus
    why = lambda chunks, split, **o: {(r.subject, r.fault) for r in pilot.pilot_faults(chunks, split, **o).collect()}
    assert why(c, s) == set()
    more = lambda *r: s.unionByName(spark.createDataFrame(list(r), s.schema))
    assert ("e1", "partitions overlap") in why(c, more(("e1", "held_out")))
    assert {("lone", "fewer than two episodes"), ("x", "no chunks")} <= why(c, more(("x", "lone")))
    assert why(c, s.where("episode <> 'e3'")) == {("e3", "not in the split")}
    assert ("e2", "unknown tag") in why(c.withColumn("difficulty", F.when(F.col("episode") == "e2", "odd").otherwise(F.col("difficulty"))), s)
    assert "too few chunks" in {f for _, f in why(c, s, total=4_000)}
    with pytest.raises(ValueError):
        pilot.freeze_pilot(c, s.where("episode <> 'e3'"))
