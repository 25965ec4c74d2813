"""Joins with many files send no table of them to the driver."""

import os

import pytest
from archlens.plans.registry import QUERIES
from archlens.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_many_files_are_not_broadcast(spark, monkeypatch):
    few = tables.path_edges(spark, DATA)
    monkeypatch.setattr(tables, "WIDE", 10)
    many = tables.path_edges(spark, DATA)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    tours = QUERIES["violations_tours"](spark, DATA)
    assert "BroadcastHashJoin" not in tours._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
