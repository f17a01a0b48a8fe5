"""Job life cycle: the batch fold against known answers, and the stream against the batch."""

import random

import pytest

from lorekeep.operators.history import fold_jobs, insert_identical
from lorekeep.operators.jobs import Rules, job_log
from lorekeep.streaming.jobs import job_transitions

SCHEMA = "job long, t long, seq long, kind string, token long"


def states(spark, rows, **more):
    rows = [(*r, None) if len(r) == 4 else r for r in rows]
    return {r.job: (r.status, r.attempts, r.due_ms) for r in fold_jobs(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_known_answers(spark):
    rows = [(1, 0, 1, "claim"), (1, 5, 2, "fail"), (1, 5_005, 3, "claim"), (1, 5_010, 4, "complete"), (2, 0, 1, "claim"), (2, 1, 2, "error"), (2, 3, 3, "claim"), (3, 1, 1, "cancel"), (4, 0, 0, "claim"), (4, 100, 1, "fail")]
    rows += [(5, t * 40_000, t, k) for t, k in enumerate(["claim", "fail"] * 3)]
    assert states(spark, rows) == {1: ("complete", 2, None), 2: ("blocked", 1, None), 3: ("cancelled", 0, None), 4: ("retry_wait", 1, 5_100), 5: ("failed", 3, None)}


def test_a_retry_is_not_claimed_before_it_is_due(spark):
    assert states(spark, [(1, 0, 0, "claim"), (1, 1, 1, "fail"), (1, 2, 2, "claim")]) == {1: ("retry_wait", 1, 5_001)}
    assert states(spark, [(1, 0, 0, "claim"), (1, 1, 1, "fail"), (1, 5_001, 2, "claim")]) == {1: ("running", 2, None)}


def test_leases(spark):
    claim, fail = (1, 0, 0, "claim"), (1, 120_000, 1, "fail")
    assert states(spark, [claim]) == {1: ("running", 1, None)} and states(spark, [claim], now=119_999) == {1: ("running", 1, None)}
    assert states(spark, [claim], now=120_000) == {1: ("queued", 1, None)} and states(spark, [claim, fail]) == {1: ("queued", 1, None)}
    beats = [claim, (1, 119_000, 1, "heartbeat"), (1, 200_000, 2, "complete")]
    assert states(spark, beats) == {1: ("complete", 1, None)} and states(spark, [claim, beats[2]]) == {1: ("queued", 1, None)}
    assert states(spark, [(1, t, t, "claim") for t in (0, 130_000, 260_000, 390_000)]) == {1: ("failed", 3, None)}
    assert states(spark, [(1, t, t, k) for t, k in ((0, "claim"), (130_000, "claim"), (260_000, "claim"), (400_000, "retry"), (400_001, "claim"))]) == {1: ("running", 1, None)}


def test_fences(spark):
    rows = [(1, 0, 0, "claim", None), (1, 130_000, 1, "claim", None), (1, 130_001, 2, "complete", 1), (1, 130_002, 3, "cancel", 1)]
    assert states(spark, rows) == {1: ("running", 2, None)}
    assert states(spark, [*rows, (1, 130_003, 4, "complete", 2)]) == {1: ("complete", 2, None)}


def test_odd_events(spark):
    rows = [(None, 0, 0, "claim", None), (1, None, 0, "claim", None), (2, 5, None, None, None), (2, 5, None, "what", None)]
    assert states(spark, rows) == {None: ("running", 1, None), 2: ("queued", 0, None)}
    assert fold_jobs(spark.createDataFrame([], SCHEMA)).count() == 0
    log = job_log(spark.createDataFrame([(1, 0, 0, "claim", None), (1, 300_000, 1, "claim", None)], SCHEMA)).orderBy("t").collect()
    assert [(r.t, r.kind, r.accepted, r.last) for r in log] == [(0, "claim", True, False), (120_000, "expire", True, False), (300_000, "claim", True, True)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["claim"] * 5 + ["heartbeat", "heartbeat", "fail", "fail", "complete", "error", "cancel", "retry"]
    rows = [(rng.randrange(40), rng.randrange(1_000_000), i, rng.choice(kinds), rng.choice([None, None, 1, 2])) for i in range(1_500)]
    end = 5_000_000
    events = spark.createDataFrame(rows, SCHEMA)
    stamped = events.unionByName(spark.createDataFrame([(-1, end, 0, "claim", None)], SCHEMA)).selectExpr("*", "timestamp_millis(t) AS ts")
    parts = stamped.where("job >= 0").selectExpr("*", "seq % 4 AS part")
    for p in range(4):  # files in an order that isn't that of time
        parts.where(f"part = {p}").drop("part").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def once():
            stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            moved = job_transitions(stream, Rules(), "2000 seconds")
            q = moved.writeStream.format("memory").queryName("moved").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True)
            q.start().awaitTermination(180)

        stamped.where("job < 0").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")  # moves the watermark to 3,000 s
        once()
        got = sorted((tuple(r) for r in spark.table("moved").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = job_log(events, Rules(), now=end - 2_000_000).drop("last")
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and {"expire", "due"} <= {r[3] for r in got}


@pytest.mark.parametrize("known", [[], [(2, "a")], [(2, "c"), (9, None)]])
def test_insert_identical_within_a_batch(spark, known):
    old = spark.createDataFrame(known, "k long, v string")
    new = spark.createDataFrame([(1, "x"), (1, "x"), (2, "a"), (2, "b"), (2, "a"), (9, None), (None, "n"), (None, "n")], "k long, v string")
    add, bad = (sorted(map(tuple, d.collect()), key=str) for d in insert_identical(old, new, ["k"]))
    nine = [] if (9, None) in known else [(9, None)]
    assert add == sorted([(1, "x"), (None, "n"), *nine], key=str)
    assert bad == {0: [(2, "a"), (2, "b")], 1: [(2, "b")], 2: [(2, "a"), (2, "b")]}[len(known)]
