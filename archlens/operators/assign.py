"""Assignment of files to groups and what is rolled up from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.graph import cut


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ``*`` any characters, ``?`` one, ``[...]`` a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = "".join("\\" + x if x in "[\\&" else x for x in glob[i + 1 : end])
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches(path: Column, glob: str) -> Column:
    """``dir/**`` takes all that lies below dir; any other glob takes paths with as many slashes that it matches, by case."""
    if glob.endswith("/**"):
        return path.startswith(glob[:-2])
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return path.rlike(glob_pattern(glob)) & (slashes == glob.count("/"))


def owners(files: DataFrame, spec: list[dict]) -> DataFrame:
    """files with ``owners``: ids of all groups of the spec that take the path, in the spec's order.

    A group has globs or a list of files. The spec is a small literal, so no join is needed: one pass, all in the scan's stage.
    """
    took = []
    for group in spec:
        if "files" in group:
            hit = F.col("path").isin(*group["files"])
        else:
            hit = F.lit(False)
            for g in group["globs"]:
                hit = hit | matches(F.col("path"), g)
        took.append(F.when(hit, F.lit(group["id"])))
    return files.withColumn("owners", F.array_compact(F.array(*took)))


def rollup(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(src, dst, type, weight, sample): file edges (src, dst, type) by the groups of their ends, of(path, layer); equal groups drop."""
    a, b = of.select(F.col("path").alias("src"), F.col("layer").alias("la")), of.select(F.col("path").alias("dst"), F.col("layer").alias("lb"))
    joined = edges.join(a, "src").join(b, "dst").where("la <> lb")
    return joined.groupBy(F.col("la").alias("src"), F.col("lb").alias("dst"), "type").agg(F.count("*").alias("weight"), F.min(F.concat_ws(" > ", joined["src"], joined["dst"])).alias("sample"))


def folders(files: DataFrame) -> DataFrame:
    """(label, parent, depth): every proper prefix of the paths."""
    parts = F.split("path", "/")
    labels = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    every = files.where(F.col("path").contains("/")).select(F.explode(labels).alias("label")).distinct()
    return every.select("label", F.when(F.col("label").contains("/"), F.regexp_replace("label", "/[^/]*$", "")).alias("parent"), (F.size(F.split("label", "/")) - 1).alias("depth"))


def compacted(files: DataFrame) -> DataFrame:
    """(label, compact_label) of the folders of files(path): one without files of its own whose only child is a folder is shown as that."""
    every = folders(files)
    kids = every.where("parent is not null").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("n"), F.min("label").alias("only"))
    own = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("p")).distinct()
    steps = cut(kids.where("n = 1").join(own, "p", "left_anti").select("p", "only"))
    shown = cut(every.select("label", F.col("label").alias("compact_label")))
    while True:
        after = cut(shown.join(steps, F.col("compact_label") == F.col("p"), "left").select("label", F.coalesce("only", "compact_label").alias("compact_label")))
        if after.join(shown, ["label", "compact_label"], "left_anti").isEmpty():
            return after
        shown = after


def manual_edges(drawn: DataFrame) -> DataFrame:
    """(src, dst, type, weight, sample, why) of edges drawn by hand, drawn(src, dst, why): each counts once and has no sample; an edge of a
    group to itself is none."""
    none = F.lit(None).cast("string").alias("sample")
    return drawn.where("src <> dst").select("src", "dst", F.lit("manual").alias("type"), F.lit(1).alias("weight"), none, F.coalesce("why", F.lit("")).alias("why"))
