"""Digests of long manifests as a tree, so that two of them are compared by what differs.

Keys are dealt to leaves by the first hex digits of their sha256, which keeps leaves even and a key in the same leaf whatever else comes or
goes. A leaf's digest is that of its lines in the order of keys, an inner node's that of its up to sixteen children. No task holds more than
a leaf, and an addition changes one node of each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.operators.graph import cut

#: Lines of a leaf, about.
LEAF = 256


def levels_for(rows: int, leaf: int = LEAF) -> int:
    """Hex digits of a leaf's place for so many lines."""
    n = 0
    while rows > leaf * 16**n:
        n += 1
    return n


def tree(rows: DataFrame, levels: int) -> DataFrame:
    """(level, place, digest, n) of all nodes of rows(key, line), the root at level 0 with place ''. Keys are unique and not null; an empty
    manifest has no node."""
    place = F.substring(F.sha2("key", 256), 1, levels) if levels else F.lit("")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n")
    node = cut(rows.groupBy(place.alias("place")).agg(F.sha2(lines, 256).alias("digest"), F.count("*").alias("n")))
    out = node.withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        above = F.substring("place", 1, level) if level else F.lit("")
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: F.concat_ws(":", x["place"], x["digest"])), "\n")
        node = cut(node.groupBy(above.alias("above")).agg(F.sha2(inner, 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("above", "place"))
        out = out.unionByName(node.withColumn("level", F.lit(level)))
    return out.select("level", "place", "digest", "n")


def differing(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """(place) of the leaves in which two trees differ, found from the roots: only children of nodes that differ are looked at."""
    at = lambda t, level, n: t.where(F.col("level") == level).select("place", F.col("digest").alias(n))
    open_ = None
    for level in range(levels + 1):
        x, y = at(a, level, "x"), at(b, level, "y")
        if open_ is not None:
            above = F.substring("place", 1, level - 1) if level > 1 else F.lit("")
            x, y = (t.withColumn("above", above).join(open_.select(F.col("place").alias("above")), "above", "left_semi").drop("above") for t in (x, y))
        open_ = cut(x.join(y, "place", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("place"))
    return open_


def changes(old: DataFrame, new: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(key, state) of the lines that two manifests (key, line) do not share: added, deleted or changed."""
    levels = levels_for(max(old.count(), new.count()), leaf)
    found = differing(tree(old, levels), tree(new, levels), levels)
    place = F.substring(F.sha2("key", 256), 1, levels) if levels else F.lit("")
    inside = lambda df, n: df.withColumn("place", place).join(found, "place", "left_semi").select("key", F.col("line").alias(n))
    both = inside(old, "x").join(inside(new, "y"), "key", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("key", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").otherwise("changed").alias("state"))
