"""Hard negatives against brute force, and bounds against exact products."""

import math
import random

import duckdb
import numpy as np
import pytest

from lorekeep.llm.negatives import NEGATIVES, bounds, hard_negatives, op13_hard_negatives, pair_bounds, summaries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, la, va) in enumerate(own):
        if a % every:
            continue
        others = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for k, (i, label, v) in enumerate(own) if k != at and len(v) == len(va)]
        others.sort()
        for s, p, _ in [o for o in others if o[2] == la][:5]:
            hits = [(i, -t) for t, i, label in others if label != la and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(hits)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * spread
    return [(i, (centres[rng.integers(6)] + rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("dim,levels", [(64, (4, 16)), (7, (2, 3, 5)), (1, (1,))])
def test_equals_brute_force(spark, dim, levels):
    rows = vectors(dim, 700, dim)
    got = rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=10, levels=levels))
    assert got == brute(rows, 10) and got


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    a, b = np.cumsum(rng.integers(-50, 50, (40, 64)), axis=1).astype(float), np.cumsum(rng.integers(-50, 50, (300, 64)), axis=1).astype(float)
    exact, width = a @ b.T, []
    for segments in (1, 4, 16, 64):
        low, high = bounds(summaries(a, segments), summaries(b, segments))
        assert (low <= exact).all() and (exact <= high).all()
        i, j = np.nonzero(np.ones(exact.shape, bool))
        lo, hi = pair_bounds(summaries(a, segments), summaries(b, segments), i, j)
        assert np.allclose(lo, low.ravel()) and np.allclose(hi, high.ravel())
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True) and width[-1] < 0.01 + 1e-6 * np.abs(exact).max()


def test_ties_and_copies(spark):
    """A third of all rows are one vector: ties go by vec_id."""
    rows = [(i, [0.5, 0.25, -1.0], i % 2) for i in range(400)] + [(i, v, label) for i, v, label in vectors(2, 800, 3)][400:]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(3)) for i in range(0, 300, 3)]
    rows += [(100, [1.0, 1.0, 0.0, 0.0], 1)] * 3 + [(200, None, 1), (None, [1.0] * 4, 1), (300, [1.0, None, 0.0, 0.0], 2), (400, [float("nan")] * 4, 1), (500, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(600, [], 1), (700, [1.0, 2.0], 1), (701, [1.0, 2.0], 1), (702, [1.0, 1.5], 2), (800, [1.0] * 4, None), (900, [0.0] * 4, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS uid", "2 AS block", "'x' AS vec", "3 AS positive_score", "4 AS rank")
    assert rows_of(hard_negatives(frame)) == brute(rows)
    assert rows_of(hard_negatives(frame.where("false"))) == []
    huge = spark.createDataFrame([(100, [1e30, 1.0], 1), (101, [2.0, 1.0], 1), (102, [2.0, 1.0], 2), (200, [2.0, 1.0], 1)], SCHEMA)
    assert {r[0] for r in rows_of(hard_negatives(huge))} == {200}


def test_long_scores_are_exact(spark):
    rows = [(i, [float(2**21 + i), float(2**20 - i), float(i)], i % 2) for i in range(90, 130)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert rows_of(op13_hard_negatives(spark, sf)) == sorted(con.sql(NEGATIVES).fetchall())
