"""Graphs in three ways: broadcast, dealt to tasks as blocks, and as joins."""

import random

import pytest
from pyspark.sql import functions as F

from archlens.operators import graph

WAYS = {"arrays": {}, "dealt": {"LOCAL_PAIRS": -1, "STEP_PAIRS": 7}, "joins": {"LOCAL_PAIRS": -1, "TASK_BYTES": -1}}


def told(df):
    return sorted((tuple(tuple(c) if isinstance(c, list) else c for c in r) for r in df.collect()), key=repr)


def test_three_ways_of_a_search_agree(spark, monkeypatch):
    rng = random.Random(7)
    nodes = [f"n{i:02}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)]
    pairs = spark.createDataFrame(edges + edges[:9], "src string, dst string").repartition(3)
    starts = spark.createDataFrame([(1, "n01"), (1, "n00"), (2, "alone"), (3, "n05"), (4, "n09")], "qid long, id string")
    targets = spark.createDataFrame([(3, "n20"), (3, "n21"), (2, "alone"), (4, "nowhere"), (1, "n01")], "qid long, id string")
    avoid = spark.createDataFrame([(1, "n02"), (3, "n07")], "qid long, id string")
    got = {}
    for way, limits in WAYS.items():
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(graph, k, v)
            got[way] = [
                told(graph.search(starts, pairs, avoid=avoid)), told(graph.search(starts, pairs, 2, chains=False)), told(graph.search(starts, pairs, targets=targets)),
                told(graph.search(starts, pairs, targets=targets, met=True)), told(graph.first_reached(starts, pairs, 5)),
            ]
    assert len(got["arrays"][0]) > 100 and {r[0] for r in got["arrays"][3]} == {1, 2, 3} and len(got["arrays"][4]) == 15
    assert got["dealt"] == got["arrays"] and got["joins"] == got["arrays"]


def test_a_dealt_search_keeps_no_level_as_a_table(spark, monkeypatch):
    """However deep, it cuts the pairs, names, questions and their numbers, and nothing for each level; no pairs reach the driver."""
    cuts, real = [], graph.cut
    monkeypatch.setattr(graph, "LOCAL_PAIRS", -1)
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or real(df))
    chain = [f"f{i:03}" for i in range(90)]
    pairs = spark.createDataFrame(list(zip(chain, chain[1:])), "src string, dst string")
    found = graph.search(spark.createDataFrame([(1, "f000")], "qid long, id string"), pairs)
    assert found.count() == 90 and found.where("depth = 89").first()["chain"] == chain and len(cuts) <= 4


@pytest.mark.parametrize("way", ["dealt", "joins"])
def test_components_in_three_ways(spark, monkeypatch, way):
    rng = random.Random(3)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)]
    frame, ids = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in nodes], "id string")
    want = told(graph.strong_components(ids, frame))
    for k, v in WAYS[way].items():
        monkeypatch.setattr(graph, k, v)
    assert told(graph.strong_components(ids, frame)) == want


def test_keys_with_names_find_what_names_do(spark, monkeypatch):
    """Ends of pairs as numbers: two ids of a key, two keys of an id, keys without id and ids without pairs."""
    rng = random.Random(11)
    names = [(i, f"n{i % 38:02}") for i in range(40)] + [(5, "other"), (90, "alone")]
    coded = [(rng.randrange(43), rng.randrange(43)) for _ in range(120)]
    spelt = [(a, b) for s, d in coded for k, a in names if k == s for j, b in names if j == d]
    pairs, table = spark.createDataFrame(coded, "src long, dst long"), spark.createDataFrame(names, "key long, id string")
    plain = spark.createDataFrame(spelt, "src string, dst string")
    starts = spark.createDataFrame([(1, "n01"), (2, "alone"), (2, "nowhere"), (3, "other")], "qid long, id string")
    found, parts = (told(graph.search(starts, plain)), told(graph.first_reached(starts, plain, 6))), told(graph.strong_components(None, plain))
    assert len(found[0]) > 60 and any(r[1] == "other" for r in found[0])
    for limits in WAYS.values():
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(graph, k, v)
            assert (told(graph.search(starts, pairs, names=table)), told(graph.first_reached(starts, pairs, 6, names=table))) == found
            assert told(graph.strong_components(None, pairs, table)) == parts


def test_no_task_gets_the_graph_by_a_shuffle(spark, monkeypatch):
    """The blocks are read where they were written, by each task that searches."""
    monkeypatch.setattr(graph, "LOCAL_PAIRS", -1)
    pairs = spark.createDataFrame([(f"f{i}", f"f{i * 7 % 50}") for i in range(50)], "src string, dst string")
    starts = spark.createDataFrame([(q, f"f{q}") for q in range(3)], "qid long, id string")
    for found, tasks in ((graph.search(starts, pairs), 3), (graph.strong_components(None, pairs), 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(f"Exchange {x}" in plan for x in ("hash", "RoundRobin", "REPARTITION", "range", "Single")) and "REPARTITION" not in plan
        assert found.where("id is not null").select(F.spark_partition_id().alias("p")).distinct().count() == tasks
    assert "Exchange" in graph.search(starts, pairs).where("qid is not null and depth > 0").groupBy("qid").count()._jdf.queryExecution().executedPlan().toString()
