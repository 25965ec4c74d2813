"""The grid of questions is parsed by all tasks, and each question is normalised once."""

import os

import pytest
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["grid_operations", "grid_summaries"])
def test_questions_are_normalised_once_by_all_tasks(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("how)'?s") == 1
    assert "RepartitionByExpression [fid" in plan


def test_operation_is_that_of_the_intent(spark):
    said = ["path to x", "how does a reach b", "path handlers", "from a to b", "who uses x", "what is x built on", "where is x", "", "from a", None, "path between a and b", "which file imports x"]
    rows = spark.createDataFrame([(q,) for q in said], "q string").select("q", T.operation(F.col("q")).alias("op"), T.intent(F.col("q"))["op"].alias("want")).collect()
    assert all(r["op"] == r["want"] for r in rows) and len({r["op"] for r in rows}) == 4
