"""Links of vectors against brute force."""

import numpy as np

import pytest

from lorekeep.llm.neighbors import FIRST, NEAREST, choose_pivots, op8_neighbors, shared_list, vector_links


def brute(rows, threshold=0.93):
    """rows: list of (id, vector, label), all valid; {id: (n_links, component)}."""
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    hit = (v @ v.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    low = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(low, np.where(hit, low[None, :], low.max()).min(axis=1))
        if (new == low).all():
            return {r[0]: (int(n), int(c)) for r, n, c in zip(rows, hit.sum(axis=1), low)}
        low = new


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_neighbors(spark, sf).collect()}
    assert got == brute(rows)


def test_recall_at_the_border_and_tiles(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(120):  # pairs at cosines of 0.93 to 1
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        u = rng.normal(size=64)
        u -= (u @ a) * a
        c = 0.931 + 0.068 * i / 120
        rows += [(2 * i, a, i % 3), (2 * i + 1, c * a + np.sqrt(1 - c * c) * u / np.linalg.norm(u), i % 3)]
    centre = rng.normal(size=64)
    rows += [(1000 + i, centre + rng.normal(size=64) * 0.15, 1) for i in range(150)]  # one dense group
    rows += [(2000 + i, 3 * centre, 1) for i in range(5)]  # copies, and at another length
    frame = spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links(frame, tile=16).collect()}
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    small = sum(got[i] == want[i] for i in range(240))
    assert small >= 0.9 * 240


def pair_at(rng, dim, cosine):
    a, u = rng.normal(size=(2, dim))
    a /= np.linalg.norm(a)
    u -= (u @ a) * a
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * u / np.linalg.norm(u)


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_pairs_at_the_border_share_a_list(dim):
    """Recall of the index itself, at the threshold, where it is least."""
    rng = np.random.default_rng(dim)
    pivots = choose_pivots(np.array([v / np.linalg.norm(v) for v in rng.normal(size=(1024, dim))]))
    near = [np.argsort(-(pivots @ np.array(pair_at(rng, dim, 0.93)).T), axis=0)[:NEAREST].T for _ in range(3000)]
    found = shared_list(np.array([n[0] for n in near]), np.array([n[1] for n in near]), FIRST)[:, 0] >= 0
    print(dim, found.mean())
    assert found.mean() > 0.98


def test_shared_list_equals_brute_force():
    rng = np.random.default_rng(1)
    a, b = (np.array([rng.permutation(12)[:6] for _ in range(500)]) for _ in range(2))
    for first in (1, 3, 6):
        lists = lambda r: {(min(x, y), max(x, y)) for i, x in enumerate(r[:first]) for y in r[i + 1 :]}
        want = [min(lists(x.tolist()) & lists(y.tolist()), default=(-1, -1)) for x, y in zip(a, b)]
        assert list(map(tuple, shared_list(a, b, first).tolist())) == want


def test_thousands_of_links(spark):
    """Clusters of many sizes, pairs at the border, one dense label, repeated vectors: against brute force."""
    rng, rows = np.random.default_rng(11), []
    for i in range(700):
        rows += [(v, 0) for v in pair_at(rng, 48, 0.931 + 0.068 * i / 700)]
    for k in range(60):
        centre = rng.normal(size=48)
        rows += [(centre + rng.normal(size=48) * 0.2, 1 + k % 3) for _ in range(2 + k % 13)]
    centre = rng.normal(size=48)
    rows += [(centre + rng.normal(size=48) * 0.12, 7) for _ in range(300)] + [(centre, 7)] * 30
    rows = [(i, v, k) for i, (v, k) in enumerate(rows)]
    frame = spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    want, got = brute(rows), {r.vec_id: (r.n_links, r.component_id) for r in vector_links(frame).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 90_000 and sum(n for n, _ in got.values()) >= 0.98 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 0), (2, [2.0, 0.0], 1, 0), (2, [2.0, 0.0], 1, 0), (3, [1.0, 0.0], None, 0), (4, None, 1, 0), (5, [0.0, 0.0], 1, 0),
            (6, [nan, 1.0], 1, 0), (7, [inf, 1.0], 1, 0), (8, [None, 1.0], 1, 0), (9, [1.0, 0.0, 0.0], 1, 0), (10, [0.0, 1.0], 2, 0), (11, [], 1, 0), (None, [1.0, 0.0], 1, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_links(frame).collect())
    assert got == [(0, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 12)]
    assert vector_links(frame.limit(0)).count() == 0


def test_a_vec_id_with_several_vectors_or_labels(spark):
    """Rows that share a vec_id are told apart by vector and label."""
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(2, 32))
    near = v + 0.01 * rng.normal(size=32)
    rows = [(1, v.tolist(), 0), (1, w.tolist(), 0), (2, near.tolist(), 0), (5, w.tolist(), 1), (1, v.tolist(), 1), (7, v.tolist(), 0)]
    got = sorted(tuple(r) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (5, 0, 5, True), (1, 0, 1, True), (7, 2, 1, False)])


def test_many_rows_share_ids(spark):
    """All ids repeat with other vectors: links and components as by brute force over rows."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 32))
    rows = [(i % 20, (centres[rng.integers(12)] + 0.1 * rng.normal(size=32)).tolist(), int(rng.integers(2))) for i in range(200)]
    unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    labels, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    reach = ids.copy()
    while True:
        new = np.minimum(reach, np.where(linked, reach[None, :], 10**9).min(axis=1))
        if (new == reach).all():
            break
        reach = new
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted(zip(ids.tolist(), linked.sum(axis=1).tolist(), reach.tolist(), strict=True))
