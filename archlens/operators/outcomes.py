"""What the scorer made of questions whose answers are known: outcomes by case, and the counts that an evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(cases: DataFrame, heads: DataFrame) -> DataFrame:
    """cases(qid, expected, target, ...) with ``said``, ``place`` and ``outcome``; heads as `scoring.heads` gives them.

    expected is match, choose or no-match. said: what the scorer came to. place: of the target among what it chose or offers, from 1, else 0.
    outcome: correct, choice (offered where it should have been matched), wrong (another node was accepted, or any where there is none) or
    lost. A case without a head counts as one that matched nothing.
    """
    rows = cases.join(heads.select("qid", "yes", "choice", "suggestions"), "qid", "left").withColumn("yes", F.coalesce("yes", F.lit(False)))
    offers = F.coalesce("suggestions", F.array().cast("array<string>"))
    said = F.when(F.col("yes"), "match").when(F.size(offers) > 0, "choose").otherwise("no-match")
    place = F.when(F.col("yes"), (F.col("choice") == F.col("target")).cast("int")).otherwise(F.array_position(offers, F.col("target")).cast("int"))
    rows = rows.withColumn("said", said).withColumn("place", F.coalesce(place, F.lit(0)))
    offered = (F.col("said") == "choose") & (F.col("place") > 0)
    right = F.when(F.col("expected") == "match", F.col("yes") & (F.col("place") == 1)).when(F.col("expected") == "choose", offered).otherwise(F.col("said") == "no-match")
    outcome = F.when(right, "correct").when(F.col("yes"), "wrong").when(offered & (F.col("expected") == "match"), "choice").otherwise("lost")
    return rows.withColumn("outcome", outcome).drop("yes", "choice", "suggestions")


def accuracy(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, n, top1, top3, abstained, false_accepts) of judged rows that have a target or should match nothing."""
    counts = [
        F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("top1"), F.count_if(F.col("place").between(1, 3)).alias("top3"), F.count_if(F.col("said") != "match").alias("abstained"),
        F.count_if((F.col("said") == "match") & (F.col("expected") == "no-match")).alias("false_accepts"),
    ]
    return rows.groupBy(*groups).agg(*counts)


def lookups(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, n, label_right, accepted_wrong, choices, suggested): labels that agree, nodes accepted wrongly, and of expected choices those that
    offered the target."""
    choose = F.col("expected") == "choose"
    counts = [
        F.count("*").alias("n"), F.count_if(F.col("said") == F.col("expected")).alias("label_right"), F.count_if(F.col("outcome") == "wrong").alias("accepted_wrong"), F.count_if(choose).alias("choices"),
        F.count_if(choose & (F.col("said") == "choose") & (F.col("place") > 0)).alias("suggested"),
    ]
    return rows.groupBy(*groups).agg(*counts)


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, n) of cases that two runs share, by outcome."""
    rows = before.select("qid", F.col("outcome").alias("before")).join(after.select("qid", F.col("outcome").alias("after")), "qid")
    return rows.groupBy("before", "after").agg(F.count("*").alias("n"))
