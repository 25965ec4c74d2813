"""The chain between two nodes by levels from both ends, and searches whose names stay a table."""

import random

import pytest

from archlens.operators import graph
from tests.test_dealt_graph import told

WAYS = {"arrays": {}, "dealt": {"LOCAL_PAIRS": -1, "STEP_PAIRS": 7}, "apart": {"LOCAL_PAIRS": -1}, "joins": {"LOCAL_PAIRS": -1, "TASK_BYTES": -1}}


def limits(m, way, pairs, nodes, both):
    """apart: what a task holds is enough for the pairs, not for the names."""
    for k, v in WAYS[way].items():
        m.setattr(graph, k, v)
    if way == "apart":
        m.setattr(graph, "TASK_BYTES", (4 * pairs + 8 * nodes) * (2 if both else 1))
        m.setattr(graph, "_search_joined", None)


@pytest.mark.parametrize("size", [70, 200])
def test_routes_are_what_levels_find(spark, monkeypatch, size):
    rng = random.Random(size)
    names = [f"n{i:02}" for i in range(60)]
    rng.shuffle(names)
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(size)]
    used = {x for e in edges for x in e}
    pairs = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    asked = [(q, rng.choice(names), rng.choice(names)) for q in range(150)] + [(200, "alone", "alone"), (201, "alone", names[0]), (202, names[0], "nowhere"), (203, edges[0][0], edges[0][0])]
    starts = spark.createDataFrame([(q, a) for q, a, _ in asked] + [(203, "alone")], "qid long, id string")
    targets = spark.createDataFrame([(q, b) for q, _, b in asked] + [(0, names[5])], "qid long, id string")
    want = told(graph.search(starts, pairs, 99, targets=targets, met=True))  # with a depth it goes by levels
    assert any(r[2] > 3 for r in want) and 20 < len(want) < len(asked) + 1
    for way in WAYS:
        with monkeypatch.context() as m:
            limits(m, way, len(edges), len(used), True)
            assert told(graph.search(starts, pairs, targets=targets, met=True)) == want, way


def test_states_by_numbers_in_every_way(spark, monkeypatch):
    rng = random.Random(5)
    names = [(i, f"n{i:02}") for i in range(40)]
    edges = [(rng.randrange(42), rng.randrange(42), rng.choice(["import", "http"])) for _ in range(110)]
    numbers, table = spark.createDataFrame(edges, "src long, dst long, type string"), spark.createDataFrame(names, "key long, id string")
    spelt = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", t) for a, b, t in edges if a < 40 and b < 40], "src string, dst string, type string")
    starts = spark.createDataFrame([(1, "n01"), (2, "n02"), (3, "alone")], "qid long, id string")
    want = told(graph.boundary_search(starts, spelt, chains=False))
    assert len(want) > 30
    for way in WAYS:
        with monkeypatch.context() as m:
            limits(m, way, 2 * len(edges), 80, False)
            assert told(graph.boundary_search(starts, numbers, chains=False, names=table)) == want, way
