"""Calls by the numbers of definitions: what searches over their ids find, and what whole answers say of them."""

from pyspark.sql import functions as F

from archlens.operators import graph, packets
from archlens.plans.registry import QUERIES
from archlens.sources import tables
from tests.test_dealt_graph import told

DATA = "/root/testdata/sf0.001"


def test_numbers_give_the_calls_of_ids(spark):
    own = tables.symbol_graph(spark, DATA)
    spelt = graph.spelled(own["calls"], own["names"]).select("src", "dst", "tier")
    assert told(spelt) == told(tables.call_edges(spark, DATA)) and dict(own["calls"].dtypes)["src"] == "bigint"


def test_searches_of_calls_keep_numbers(spark, monkeypatch):
    """No id of a definition is written or shuffled for each call."""
    seen, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(dict(df.dtypes)) or real(df))
    for name in ("symbol_trace", "symbol_flow"):
        seen.clear()
        QUERIES[name](spark, DATA)
        kinds = [d["src"] for d in seen if {"src", "dst"} <= set(d)]
        assert kinds and set(kinds) == {"bigint"}


def test_one_step_by_joins_is_one_step_of_a_search(spark, monkeypatch):
    names = spark.createDataFrame([(i, f"n{i % 18:02}") for i in range(20)] + [(5, "other"), (30, "alone")], "key long, id string")
    pairs = spark.createDataFrame([(i % 20, i * 7 % 23) for i in range(60)] + [(3, 3), (3, 3)], "src long, dst long")
    starts = spark.createDataFrame([(1, "n01"), (1, "n07"), (2, "alone"), (3, "other"), (3, "n05"), (4, "nowhere"), (5, None)], "qid long, id string")
    want = told(graph.search(starts.where("id is not null"), pairs, 1, names=names).where("depth > 0"))
    assert len(want) > 5 and told(packets.stepped(starts, pairs, names)) == want
    assert told(packets.stepped(starts, graph.spelled(pairs, names))) == want
    monkeypatch.setattr(graph, "WIDE_ROWS", 0)
    assert told(packets.stepped(starts, pairs, names)) == want
    wanted = spark.createDataFrame([("n03", "n03"), ("n01", "n07"), ("n01", "n08"), ("gone", "n01")], "src string, dst string")
    pairs = pairs.withColumn("type", F.lit("x"))
    here = told(graph.spelled(pairs, names).join(wanted, ["src", "dst"], "left_semi").select("src", "dst", "type"))
    assert here and told(packets.among(wanted, pairs, names)) == here and told(packets.among(wanted, graph.spelled(pairs, names))) == here


def test_a_graph_is_not_made_for_no_question(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "CALLERS", ["b"]), (2, "CALLEES", ["a"]), (3, "LOCATE", ["a"])], "qid long, op string, ids array<string>")
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "src string, dst string")
    monkeypatch.setattr(graph, "search", None)
    found = packets.reached(rows, calls, packets.BACKWARD, ("CALLERS", "CALLEES"))
    assert told(found) == [(1, "a", 1, ("b", "a"), 1, 1), (2, "b", 1, ("a", "b"), 1, 1)]


def test_only_rows_of_a_packet_leave_the_search(spark, monkeypatch):
    """Whatever a question reaches, no more rows than are asked for are written, with the number of all."""
    rows = spark.createDataFrame([(1, "DOWNSTREAM", ["hub"]), (2, "PATH", ["f07", "hub"]), (3, "UPSTREAM", ["f03"])], "qid long, op string, ids array<string>")
    edges = spark.createDataFrame([(f"f{i:02}", "hub") for i in range(40)], "src string, dst string")
    found = packets.reached(rows, edges, packets.BACKWARD, most=5)
    assert told(found.where("qid = 1").select("id", "n", "total")) == [(f"f{i:02}", i + 1, 40) for i in range(5)]
    assert told(found.where("qid > 1")) == [(2, "hub", 1, ("f07", "hub"), 1, 1), (3, "hub", 1, ("f03", "hub"), 1, 1)]
