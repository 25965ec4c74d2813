"""Searches go on until nothing new is met: against breadth-first search, farther than any earlier bound."""

import os
from collections import deque

import pytest
from archlens.engine import Engine
from archlens.operators import graph
from archlens.plans.registry import QUERIES
from archlens.sources.tables import path_edges

DATA = "/root/testdata/sf0.001"


def distances(near, start):
    depth, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


def test_engine_follows_a_long_chain(spark):
    paths = [f"app/f{i:02}.py" for i in range(36)]
    nodes = spark.createDataFrame([(p, "file", p) for p in paths], "id string, kind string, path string")
    edges = spark.createDataFrame([(a, b, "import") for a, b in zip(paths, paths[1:])] + [(paths[5], paths[2], "import")], "src string, dst string, type string")
    asked = spark.createDataFrame([(1, "dependencies of f00.py"), (2, "What depends on f35.py?"), (3, "How does f00 reach f35?")], "qid long, question string")
    got = {}
    for r in Engine(nodes, edges).answer(asked).collect():
        got.setdefault(r["qid"], []).append((r["status"], r["depth"]))
    assert sorted(got[1]) == sorted(got[2]) == [("matched", d) for d in range(1, 36)]
    assert got[3] == [("matched", 35)]


def test_boundary_search_follows_a_long_chain(spark):
    """The only link that is no import comes late; what lies behind it is met across a boundary, and the start is not met again."""
    ids = [f"f{i:02}" for i in range(33)]
    edges = [(a, b, "http" if b == "f29" else "import") for a, b in zip(ids, ids[1:])] + [(ids[-1], ids[0], "rpc"), (ids[0], ids[5], "rpc")]
    start = spark.createDataFrame([(1, ids[0])], "qid long, id string")
    found = graph.boundary_search(start, spark.createDataFrame(edges, "src string, dst string, type string"))
    got = {r["id"]: (r["depth"], r["chain"]) for r in found.collect()}
    assert set(got) == set(ids[5:]) and got["f05"] == (1, ["f00", "f05"]) and got["f32"][0] == 28


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_answer_batch_counts_all_that_is_reached(spark):
    on, back = {}, {}
    for r in path_edges(spark, DATA).select("src", "dst").distinct().collect():
        on.setdefault(r["src"], []).append(r["dst"])
        back.setdefault(r["dst"], []).append(r["src"])
    rows = QUERIES["answer_batch"](spark, DATA).where("op in ('UPSTREAM', 'DOWNSTREAM') and target is not null").collect()
    assert rows
    for r in rows:
        want = len(distances(on if r["op"] == "UPSTREAM" else back, r["target"]))
        assert r["n_nodes"] == want, r
