"""Connected components against union-find."""

import random

import pytest

from cataloom.llm import pairs
from cataloom.llm.components import components


def union_find(edges):
    at = {}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        at.setdefault(a, a)
        at.setdefault(b, b)
        x, y = root(a), root(b)
        at[max(x, y)] = min(x, y)
    return {x: root(x) for x in at}


def run(spark, edges, schema="a long, b long, node string, component string"):
    return {r["node"]: r["component"] for r in components(spark.createDataFrame([(a, b, "x", "y") for a, b in edges], schema)).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    assert run(spark, edges) == union_find(edges)


def test_chain_star_repeats_and_reversals(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(141, 140)]
    star = [(5, i) for i in range(200, 240)]
    edges = chain + star + star[:5] + [(b, a) for a, b in chain[:5]]
    assert run(spark, edges) == union_find(edges)


def test_nulls_loops_and_empty(spark):
    assert run(spark, [(None, 1), (2, None), (3, 3)]) == {3: 3}
    assert run(spark, []) == {}


def test_scene_groups(spark):
    schema = "id long, type string, status string, target_id string, details string, confidence double, a string, node long"
    row = lambda target, conf=0.9, status="pending", kind="duplicate_scenes", details=None: (1, kind, status, target, details, conf, "z", 1)
    rows = [
        row("1:2"), row(" 2 : 3 "), row("2:3"), row("4:4"), row("5:"), row("6;7"), row("x8:9"), row(None), row("10:11", 0.79), row("12:13", 85.0), row("14:15", None, details='{"confidence": 80.0}'),
        row("16:17", None), row("18:19", status="dismissed"), row("20:21", kind="other"), row("22:23", status=None), row("1:2:3"), row("24:25", 0.8), row("26:27", None, details="not json"),
    ]
    got = {r["scene_id"]: r["group_id"] for r in pairs.scene_groups(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 12: 12, 13: 12, 14: 14, 15: 14, 22: 22, 23: 22, 24: 24, 25: 24}
