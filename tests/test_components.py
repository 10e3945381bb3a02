"""Components against union-find on random graphs and awkward shapes."""

import random

import pytest

from shutterfold.operators.components import connected_components


def brute(edges):
    up = {}
    for a, b in edges:
        a, b = (a if a is not None else b), (b if b is not None else a)
        if a is None:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        x, y = up[a], up[b]
        if x != y:
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    return up


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 500), (None, 501), (502, None), (None, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_chain_hub_and_empty(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001 + i) for i in range(400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1001 + i] for i in range(400)} == {1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_text_nodes(spark):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "x")], "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x"}


def test_rounds_leave_the_planner_small_numbers(spark):
    order = list(range(3000))
    random.Random(5).shuffle(order)
    found = connected_components(spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long"))
    assert {r.component for r in found.collect()} == {0}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2000  # five times as many bits a round before
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
