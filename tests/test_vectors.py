"""The kept index of cells gives what brute force gives, and reads fewer rows where vectors lie in clusters."""

import duckdb
import numpy as np
import pytest

from lorekeep.functions.work import new_path
from lorekeep.operators import vectors
from lorekeep.plans import catalog


def _unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def _frames(spark, v, groups, asked):
    rows = spark.createDataFrame([(i, g, r.tolist()) for i, (g, r) in enumerate(zip(groups, v))], "row_id long, row_group long, row_vector array<double>")
    queries = spark.createDataFrame([(int(i), groups[i], v[i].tolist()) for i in asked], "query_id long, query_group long, query_vector array<double>")
    return rows, queries


def _brute(v, groups, asked, k):
    out = set()
    for i in asked:
        s = np.round(v @ v[i], 9)
        near = [j for j in np.lexsort((np.arange(len(v)), -s)) if groups[i] is None or groups[j] != groups[i]][:k]
        out |= {(int(i), int(j), n + 1) for n, j in enumerate(near)}
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_cells_equal_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)  # several tiles a cell
    rng = np.random.default_rng(5)
    middle = _unit(rng.normal(size=(12, 16)))
    v = _unit(middle[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 16))) if clustered else _unit(rng.normal(size=(900, 16)))
    v[100:140] = v[7]  # ties go by id
    groups = [int(g) for g in rng.integers(0, 6, 900)]
    asked = list(range(0, 900, 30)) + [7, 101]
    rows, queries = _frames(spark, v, groups, asked)
    found = vectors.nearest(queries, rows, 5, cells=24).collect()
    assert {(r.query_id, r.row_id, r["rank"]) for r in found} == _brute(v, groups, asked, 5)


def test_cells_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    middle = _unit(rng.normal(size=(20, 24)))
    v = _unit(middle[np.arange(2_000) % 20] + 0.02 * rng.normal(size=(2_000, 24)))
    rows, queries = _frames(spark, v, [i // 20 for i in range(2_000)], range(0, 2_000, 100))
    folder = new_path(spark, "cells-test")
    vectors.build_cells(rows, folder, cells=80)
    index, visited, scan = vectors.open_cells(spark, folder), [], vectors._scan
    monkeypatch.setattr(vectors, "_scan", lambda i, visits, k: visited.append(visits.groupBy("cell").count().count()) or scan(i, visits, k))
    found = vectors.nearest_in(index, queries, 10).collect()
    assert {(r.query_id, r.row_id, r["rank"]) for r in found} == _brute(v, [i // 20 for i in range(2_000)], range(0, 2_000, 100), 10)
    assert sum(visited) <= 24  # of 80: the queries lie in one of twenty clusters


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 2, None), (4, 2, [0.0, 1.0])], "row_id long, row_group long, row_vector array<double>")
    queries = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 1, None)], "query_id long, query_group long, query_vector array<double>")
    assert sorted(map(tuple, vectors.nearest(queries, rows, 3).select("query_id", "row_id", "rank").collect())) == [(1, 4, 1), (2, 1, 1), (2, 4, 2)]
    assert vectors.nearest(queries, rows.where("false"), 3).count() == 0
    assert vectors.nearest(queries.where("false"), rows, 3).count() == 0


def test_unit_vectors(spark):
    got = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("inf"), 1.0]), (3, None), (4, [float("nan"), 1.0])], "i int, v array<float>").select("i", vectors.l2_normalize("v").alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [[0.6, 0.8], None, None, None, None]


def test_scores_are_rounded_once_and_ranked_as_rounded(spark, tmp_path):
    """A score just below half a unit of the sixth digit isn't rounded up by way of the ninth; equal ones go by id."""
    cosines = [1.0, 0.9915684996, 0.5000001, 0.5000003, 0.4999999, 0.2500005001, 0.25000049990]
    rows = [(i, [c, (1.0 - c * c) ** 0.5]) for i, c in enumerate(cosines)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, catalog.queries()["e4_knn"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.sql(catalog.oracle_sql()["e4_knn"]).fetchall()) and [r[1:] for r in got[:4]] == [(1, 0.991568, 1), (2, 0.5, 2), (3, 0.5, 3), (4, 0.5, 4)]


def test_coarse_scores_rule_out_no_tie(spark):
    rng = np.random.default_rng(8)
    middle = _unit(rng.normal(size=(12, 16)))
    v = _unit(middle[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16)))
    groups, asked = [i % 5 for i in range(900)], list(range(0, 900, 30))
    rows, queries = _frames(spark, v, groups, asked)
    folder = new_path(spark, "cells-test")
    vectors.build_cells(rows, folder, cells=40)
    found = vectors.nearest_in(vectors.open_cells(spark, folder), queries, 5, digits=1).collect()
    want = set()
    for i in asked:
        s = np.round(v @ v[i], 1)
        want |= {(i, int(j), n + 1) for n, j in enumerate([j for j in np.lexsort((np.arange(900), -s)) if j % 5 != i % 5][:5])}
    assert {(r.query_id, r.row_id, r["rank"]) for r in found} == want
