"""Connected components of a graph given as an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import Scratch

#: Edges up to which the tables of a round are broadcast (4 MB of numbers); beyond, both sides of its joins are written and shuffled.
BROADCAST = 250_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each end of an edge (a, b); component: the smallest id that can be reached. Ids are any 64-bit numbers.

    Alternates large-star and small-star steps: each hangs a node's neighbours on the smallest of them, so chains halve and a
    hub is a partial minimum, never a collected list. Few edges are joined by broadcast; of more, both sides of each join are
    tables, joined by sorting, so that adaptive execution can split a hub's edges over many tasks. Loops and repeated edges are harmless; it ends when a
    round changes nothing.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = scratch.put(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        made: list = []

        def side(df: DataFrame, few: bool = mark[0] <= BROADCAST, made: list = made) -> DataFrame:
            if few:
                return F.broadcast(df)
            made.append(scratch.put(df, "side"))
            return made[-1].hint("merge")

        # The larger end of an edge hangs on the least neighbour of the smaller one, where that is not the end itself.
        low = side(now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")))
        large = now.join(low, now["v"] == low["id"], "left").select("u", F.coalesce("m", "v").alias("v"))
        if mark[0] > BROADCAST:
            large = scratch.put(large.distinct(), "side")
            made.append(large)
        least = side(large.groupBy("u").agg(F.min("v").alias("m")))
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        after = scratch.put(large.join(least, "u").select(F.explode(both).alias("e")).select("e.*").where("u <> v").distinct(), "cc")
        was, mark = mark, _mark(after)
        scratch.drop(now, *made)
        now = after
        if was == mark:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    row = edges.agg(F.count("*").alias("n"), exact(F.xxhash64("u", "v")).alias("h"), exact(F.col("v")).alias("s")).first()
    return row["n"], row["h"], row["s"]
