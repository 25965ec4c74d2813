"""The greatest weight of each chain, without the chains."""

import random

from archlens.operators import graph
from tests.test_dealt_graph import WAYS


def test_three_ways_give_the_weights_of_the_chains(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [f"n{i:02}" for i in range(60)]
    weight = {(rng.choice(nodes), rng.choice(nodes)): rng.randint(1, 4) for _ in range(150)}
    calls = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src string, dst string, weight long").repartition(3)
    starts = spark.createDataFrame([(1, "n01"), (1, "n00"), (2, "alone"), (3, "n05"), (4, "n09")], "qid long, id string")
    want = [(r.qid, r.id, r.depth, max((weight[p] for p in zip(r.chain, r.chain[1:])), default=0)) for r in graph.search(starts, calls).collect()]
    assert len({w for *_, w in want}) > 3
    for limits in WAYS.values():
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(graph, k, v)
            found = graph.heaviest(starts, calls)
            assert found.columns == ["qid", "id", "depth", "weight"]
            assert sorted(tuple(r) for r in found.collect()) == sorted(want)
