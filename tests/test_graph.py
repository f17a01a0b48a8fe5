"""Components against a union of sets, and what is left of long chains for the rounds of stars."""

import random

import pytest

from lorekeep.operators import graph
from lorekeep.operators.graph import connected_components


def brute(links):
    parts = {}
    for a, b in links:
        if a is None or b is None or a == b:
            continue
        one = parts.get(a, {a}) | parts.get(b, {b})
        for node in one:
            parts[node] = one
    return sorted((node, min(one)) for node, one in parts.items())


def tables():
    rng = random.Random(7)
    order = list(range(1, 400))
    rng.shuffle(order)
    yield "chain", [(i, i + 1) for i in range(300)]
    yield "shuffled chain", list(zip(order, order[1:], strict=False))
    yield "star", [(10_000, i) for i in range(200)] + [(i, -1) for i in range(500, 600)]
    yield "random", [(rng.randrange(500), rng.randrange(500)) for _ in range(450)] + [(3, 3), (None, 4), (5, None), (9, 8), (9, 8)]
    yield "nothing", [(1, 1), (None, None)]


@pytest.mark.parametrize("chunk", [4, 1 << 18])
@pytest.mark.parametrize("links", [pytest.param(x, id=n) for n, x in tables()])
def test_components_equal_brute_force(spark, links, chunk):
    got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(3), chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute(links)


def test_other_ends(spark):
    words = [("b", "é"), ("é", "日"), ("x", "y"), ("\U00010000", "￿")]
    assert sorted(map(tuple, connected_components(spark.createDataFrame(words, "a string, b string")).collect())) == brute(words)
    halves = [(0.5, 1.5), (1.5, 2.5), (9.5, 8.5)]
    assert sorted(map(tuple, connected_components(spark.createDataFrame(halves, "a double, b double")).collect())) == brute(halves)


def test_a_long_chain_takes_few_writes(spark, monkeypatch):
    """Rounds of stars write a table each, nine and more for such a chain."""
    written, materialize = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    links = spark.range(20_000).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(links)
    assert got.where("component = 0").count() == 20_001 and len(written) <= 8
