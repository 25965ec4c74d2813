"""Folders as intervals: paths in order give every folder a range of ranks, so what lies below it is found without walking the tree.

All paths with a common prefix follow each other in the order of paths, so a folder is an interval of ranks, intervals nest or are
apart, and one folder lies in another if its interval does. Points meet intervals by equal joins: an interval is cut into the few
aligned blocks that fill it, of 1, 2, 4, ... ranks, and a point lies in one block of each size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.operators.graph import cut

#: Sizes of blocks, as powers of two: ranks up to 2**40.
LEVELS = 40


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``rank``: their place from 0 in the order of key, which is unique. Sorted by ranges; only the number of rows of each range is
    brought together."""
    placed = cut(rows.orderBy(key).withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return placed.withColumn("own", own).join(F.broadcast(before), "range").withColumn("rank", F.col("own") + F.col("before")).drop("range", "own", "before")


def prefixes(path):
    """The folders that a path lies in, the outermost first."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, every).otherwise(F.array().cast("array<string>"))


def intervals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, rank) of files(path), and (label, parent, depth, lo, hi) of their folders: ranks lo to hi are what lies below one."""
    points = cut(ranked(files.select("path").distinct(), "path"))
    every = points.select("rank", F.explode(prefixes(F.col("path"))).alias("label"))
    spans = every.groupBy("label").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    depth = F.size(F.split("label", "/")) - 1
    return points, spans.select("label", F.when(depth > 0, F.regexp_replace("label", "/[^/]*$", "")).alias("parent"), depth.alias("depth"), "lo", "hi")


def blocks(lo, hi):
    """The aligned blocks (level, block) that fill the ranks lo to hi: at each level one at either end at most, while it has no partner within."""
    end = hi + 1
    # At level k the uncovered part is from ceil(lo / 2**k) to floor(end / 2**k); an odd border has a block of its own.
    at = lambda k: (F.ceil(lo / F.pow(F.lit(2.0), k)).cast("long"), F.floor(end / F.pow(F.lit(2.0), k)).cast("long"))

    def of(k):
        a, b = at(k)
        left = F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("block")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)))


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(rank, ...) joined to the rows of spans(lo, hi, ...) in which they lie."""
    cutup = cut(spans.withColumn("b", F.explode(blocks(F.col("lo"), F.col("hi")))).select("*", "b.level", "b.block").drop("b"))
    used = cutup.select("level").distinct()  # LEVELS rows at most
    keyed = points.crossJoin(F.broadcast(used)).withColumn("block", F.floor(F.col("rank") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    return keyed.join(cutup, ["level", "block"]).drop("level", "block")


def folder_id(label):
    return F.concat(F.lit("folder-"), F.substring(F.sha2(label, 256), 1, 16))


def listing(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, n, kind, id) of asked(qid, label): what lies in a folder, folders first, level by level and those of a folder in the order of
    their ids, then files in order of their paths; n from 1. A folder that is not there has no row."""
    points, spans = intervals(files)
    spans = cut(spans)
    roots = asked.join(spans, "label").select("qid", "lo", "hi", F.col("depth").alias("at"))
    ids = F.transform(F.concat(prefixes(F.col("label")), F.array("label")), folder_id)
    inner = within(spans.select(F.col("lo").alias("rank"), F.col("hi").alias("end"), "label", "depth"), roots).where("end <= hi and depth > at")
    inner = inner.select("qid", F.lit(0).alias("k"), F.lit("layer").alias("kind"), folder_id(F.col("label")).alias("id"), (F.col("depth") - F.col("at")).alias("level"), ids.alias("order"))
    own = within(points, roots).select("qid", F.lit(1).alias("k"), F.lit("file").alias("kind"), F.col("path").alias("id"), F.lit(0).alias("level"), F.array("path").alias("order"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("k", "level", "order"))
    return inner.unionByName(own).select("qid", place.cast("long").alias("n"), "kind", "id")


def collapsed(files: DataFrame, edges: DataFrame, opened: DataFrame) -> DataFrame:
    """(session, src, dst, type, weight) for each session of opened(session, label): edges(src, dst, type) of files between what is seen.

    A file is seen where all its folders are open, else the outermost of them that is not; edges within one are left out. Edges of closed
    top folders are counted once for all sessions: a session costs what lies in the folders that it opens.
    """
    points, spans = intervals(files)
    spans = cut(spans)
    sessions = opened.select("session").distinct()
    shown = opened.distinct().join(spans, "label").select("session", "lo", "hi", F.col("depth").alias("d"))
    met = within(points, shown).groupBy("session", "path").agg(F.collect_set("d").alias("open"))
    folders_ = prefixes(F.col("path"))
    first = F.get(F.filter(F.sequence(F.lit(0), F.size("open")), lambda d: ~F.array_contains("open", d)), F.lit(0))
    seen = F.coalesce(F.get(folders_, first), F.col("path"))
    changed = cut(met.select("session", "path", seen.alias("seen")).where(seen != F.get(folders_, F.lit(0))))

    top = lambda c: F.coalesce(F.get(prefixes(F.col(c)), F.lit(0)), F.col(c))
    edges = edges.where(~F.col("type").isin("realtime")).select("src", "dst", "type").distinct()
    tops = edges.select("src", "dst", "type", top("src").alias("s"), top("dst").alias("t"))
    whole = cut(tops.groupBy("s", "t", "type").agg(F.count("*").alias("n")))
    touched = changed.select("session", F.col("path").alias("src")).join(tops, "src").unionByName(changed.select("session", F.col("path").alias("dst")).join(tops, "dst"))
    touched = cut(touched.select("session", "src", "dst", "type", "s", "t").distinct())
    a, b = (changed.select("session", F.col("path").alias(e), F.col("seen").alias(f"seen_{e}")) for e in ("src", "dst"))
    exact = touched.join(a, ["session", "src"], "left").join(b, ["session", "dst"], "left")
    exact = exact.select("session", F.coalesce("seen_src", "s").alias("src"), F.coalesce("seen_dst", "t").alias("dst"), "type", F.lit(1).cast("long").alias("n"))
    # All edges between closed tops, less those that the session shows more closely.
    rest = sessions.crossJoin(F.broadcast(whole.where("s <> t"))).select("session", F.col("s").alias("src"), F.col("t").alias("dst"), "type", "n")
    less = touched.select("session", F.col("s").alias("src"), F.col("t").alias("dst"), "type", F.lit(-1).cast("long").alias("n"))
    rows = exact.unionByName(rest).unionByName(less).where("src <> dst")
    return rows.groupBy("session", "src", "dst", "type").agg(F.sum("n").alias("weight")).where("weight > 0")
