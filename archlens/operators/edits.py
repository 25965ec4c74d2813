"""Edits of groups: of tables, a batch of sessions at once, and of a literal spec; pure, each gives new groups and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.operators.assign import glob_pattern
from archlens.operators.graph import cut


def _find(spec: list[dict], id_: str) -> int:
    for i, g in enumerate(spec):
        if g["id"] == id_:
            return i
    raise KeyError(id_)


def rename(spec: list[dict], id_: str, label: str) -> tuple[list[dict], list[str]]:
    at = _find(spec, id_)
    return [*spec[:at], {**spec[at], "label": label}, *spec[at + 1 :]], []


def move(spec: list[dict], path: str, to: str) -> tuple[list[dict], list[str]]:
    """A file of a list goes to another group's list; a group of globs cannot take a single file."""
    target = _find(spec, to)
    if "files" not in spec[target]:
        return spec, [f"{to} takes globs, {path} stays"]
    out = [{**g, "files": [f for f in g["files"] if f != path]} if "files" in g else dict(g) for g in spec]
    out[target]["files"] = sorted({*out[target]["files"], path})
    return out, [f"{g['id']} is empty" for g in out if "files" in g and not g["files"]]


def merge(spec: list[dict], a: str, b: str) -> tuple[list[dict], list[str]]:
    """b's entries join a's; only groups of the same kind merge."""
    x, y = spec[_find(spec, a)], spec[_find(spec, b)]
    kind = "files" if "files" in x else "globs"
    if kind not in y:
        return spec, [f"{a} and {b} differ in kind"]
    joined = {**x, kind: list(dict.fromkeys([*x[kind], *y[kind]]))}
    return [joined if g["id"] == a else g for g in spec if g["id"] != b], []


def split(spec: list[dict], id_: str, glob: str, new: str) -> tuple[list[dict], list[str]]:
    """Files of a list that a glob takes become a group of their own, after it."""
    import re

    at = _find(spec, id_)
    if "files" not in spec[at] or any(g["id"] == new for g in spec):
        return spec, [f"{id_} cannot be split into {new}"]
    took = lambda f: f.startswith(glob[:-2]) if glob.endswith("/**") else bool(re.match(glob_pattern(glob), f)) and f.count("/") == glob.count("/")
    inside = [f for f in spec[at]["files"] if took(f)]
    rest = [f for f in spec[at]["files"] if not took(f)]
    warn = [f"{g} is empty" for g, files in ((new, inside), (id_, rest)) if not files]
    return [*spec[:at], {**spec[at], "files": rest}, {"id": new, "label": new, "files": inside}, *spec[at + 1 :]], warn


def delete(spec: list[dict], id_: str) -> tuple[list[dict], list[str]]:
    at = _find(spec, id_)
    return [*spec[:at], *spec[at + 1 :]], [f"files of {id_} have no group"]


def edited(groups: DataFrame, members: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, id, label, files) after the edit of each session, and (session, warning).

    groups(id, label), members(id, path): a file lies in one group at most. edits(session, op, a, b): rename a to label b, move file a to b,
    merge b into a, split files below folder b off a into a group of that name, delete a. An edit that names a group that is not there, or
    splits into one that is, changes nothing and warns. Files are counted once for all sessions; an edit adds what it changes.
    """
    sizes = cut(groups.join(members.groupBy("id").agg(F.count("*").alias("files")), "id", "left").select("id", "label", F.coalesce("files", F.lit(0)).alias("files")))
    known = sizes.select("id", "files")
    size = lambda key, name: known.select(F.col("id").alias(key), F.col("files").alias(name))
    asked = edits.join(size("a", "size_a"), "a", "left").join(size("b", "size_b"), "b", "left")
    asked = asked.join(members.select(F.col("path").alias("a"), F.col("id").alias("owner")), "a", "left")
    inside = edits.where("op = 'split'").select("session", F.col("a").alias("id"), "b").join(members, "id").where(F.col("path").startswith(F.concat("b", F.lit("/"))))
    taken = inside.groupBy("session").agg(F.count("*").alias("taken"))
    asked = asked.join(taken, "session", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    has_a, has_b, is_ = F.col("size_a").isNotNull(), F.col("size_b").isNotNull(), lambda op: F.col("op") == op
    fits = F.when(is_("move"), F.col("owner").isNotNull() & has_b & (F.col("owner") != F.col("b"))).when(is_("merge"), has_a & has_b & (F.col("a") != F.col("b"))).when(is_("split"), has_a & ~has_b).otherwise(has_a & F.col("op").isin("rename", "delete"))
    asked = cut(asked.withColumn("fits", fits))
    done = asked.where("fits")
    row = lambda id_, n: F.struct(id_.alias("id"), n.cast("long").alias("n"))
    a, b, one = F.col("a"), F.col("b"), F.lit(1)
    change = (
        F.when(is_("move"), F.array(row(F.col("owner"), -one), row(b, one)))
        .when(is_("merge"), F.array(row(a, F.col("size_b"))))
        .when(is_("split"), F.array(row(a, -F.col("taken")), row(b, F.col("taken"))))
    )
    changes = done.select("session", F.explode(change).alias("c")).select("session", "c.id", "c.n")
    gone = done.where("op in ('merge', 'delete')").select("session", F.when(is_("merge"), b).otherwise(a).alias("id"))
    named = done.where("op = 'rename'").select("session", a.alias("id"), b.alias("new"))
    every = edits.select("session").distinct().crossJoin(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes).join(gone, ["session", "id"], "left_anti")
    every = every.unionByName(done.where("op = 'split'").select("session", b.alias("id"), b.alias("label"), F.lit(0).cast("long").alias("files")))
    out = every.join(changes.groupBy("session", "id").agg(F.sum("n").alias("n")), ["session", "id"], "left").join(named, ["session", "id"], "left")
    out = cut(out.select("session", "id", F.coalesce("new", "label").alias("label"), (F.col("files") + F.coalesce("n", F.lit(0))).alias("files")))
    empty = out.join(changes.select("session", "id").distinct(), ["session", "id"], "left_semi").where("files = 0").select("session", F.concat("id", F.lit(" is empty")).alias("warning"))
    lost = done.where("op = 'delete' and size_a > 0").select("session", F.concat(F.lit("files of "), a, F.lit(" have no group")).alias("warning"))
    odd = asked.where("not fits").select("session", F.concat_ws(" ", "op", "a", F.lit("changes nothing")).alias("warning"))
    return out, empty.unionByName(lost).unionByName(odd)
