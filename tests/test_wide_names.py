"""Tables of names with many rows are joined by sorting: none goes through the driver, whatever its size is estimated at."""

import os

import pytest
from archlens.operators import graph, scoring
from archlens.plans import scoring as plans
from archlens.sources.tables import code_symbols

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_many_names_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "WIDE_ROWS", 50)
    index = graph.wide(graph.cut(scoring.indexed(plans.nodes(spark, DATA))))
    symbols = graph.wide(graph.cut(code_symbols(spark, DATA).select("id", "name", "qualname", "path")))
    names = graph.wide(graph.cut(scoring.symbol_names(symbols)))
    asked = spark.createDataFrame([(1, "what calls almond"), (2, "almond")], "qid long, question string")
    alone = scoring._names_alone(asked.withColumnRenamed("question", "normal"), index, names)
    assert alone.count() <= 2
    assert "BroadcastHashJoin" not in plan(alone)
    assert "BroadcastHashJoin" not in plan(scoring.bare_candidates(asked.selectExpr("qid", "question as name", "'file' as hint"), index))
    many = scoring.resolved(asked, index, symbols).collect()
    monkeypatch.setattr(graph, "WIDE_ROWS", 10**9)
    assert sorted(map(str, many)) == sorted(map(str, scoring.resolved(asked, graph.cut(index), graph.cut(symbols)).collect()))
