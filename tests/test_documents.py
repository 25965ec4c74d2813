"""Listings in one file, portable paths, snapshot documents, manifests as trees, edits and chains of configurations."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from archlens.operators import edits, manifest, validate
from archlens.sources import inventory as inv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_listing_is_read_by_many_tasks(spark, tmp_path):
    records = [f"100644 blob {hashlib.sha1(str(i).encode()).hexdigest()} {i}\tfolder/a\nname {i} {'x' * (i % 97)}" for i in range(4000)]
    (tmp_path / "listing").write_bytes("".join(r + "\x00" for r in records).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (997, 4096):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            tree = inv.read_listing(spark, str(tmp_path / "listing"))
            assert tree.rdd.getNumPartitions() > 60
            assert sorted(r["size"] for r in tree.collect()) == list(range(4000)) and tree.where("not valid").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_paths_that_are_one_file_elsewhere(spark):
    paths = ["a/B", "A/b", "straße", "STRASSE", "é", "é", "x. /y", "x/y", "ok/NUL.txt", "com0", "Com1", None, "d" * 4097]
    got = {r["path"]: r["p"] for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", inv.portable("path").alias("p")).collect()}
    assert got["a/B"]["key"] == got["A/b"]["key"] and got["straße"]["key"] == got["STRASSE"]["key"] == "strasse" and got["é"]["key"] == got["é"]["key"]
    assert got["x. /y"]["key"] == "x/y" and not got["é"]["composed"] and got["é"]["composed"]
    tree = spark.createDataFrame([(p, True) for p in paths if p is not None], "path string, valid boolean")
    found = {}
    for r in inv.listing_violations(tree).collect():
        found.setdefault(r["rule"], set()).add(r["what"])
    assert found == {"portable collision": {"A/b", "STRASSE", "é", "x. /y"}, "unsafe path": {"é", "d" * 4097}, "trailing dot or space": {"x. /y"}, "reserved name": {"ok/NUL.txt", "Com1"}}


def test_documents_are_refused_for_a_reason(spark):
    good = {"schema": "s", "projectId": "p", "snapshotId": "1", "inventory": [{"path": "a", "sha256": "0", "lineCount": 2}]}
    texts = {
        "good": json.dumps(good), "twice": '{"schema": "s", "schema": "t"}', "two": json.dumps(good) + json.dumps(good), "list": "1, 2", "number": "7", "null": '{"schema": null, "projectId": "p", "snapshotId": "1", "inventory": []}',
        "deep": json.dumps(good | {"inventory": [{"path": "a", "sha256": None}, {"path": "a", "lineCount": "many"}]}), "more": json.dumps(good | {"x": 1}), "none": None, "empty": "",
    }
    docs = spark.createDataFrame([(n, t, hashlib.sha256((t or "").encode()).hexdigest() if n != "number" else "0") for n, t in texts.items()], "name string, document string, sha256 string")
    loaded, refused = inv.load_documents(docs)
    assert [(r["name"], r["inventory"][0]["lineCount"]) for r in loaded.collect()] == [("good", 2)]
    got = {}
    for r in refused.collect():
        got.setdefault(r["name"], set()).add(r["problem"])
    lost = {"no JSON or a repeated key"}
    assert got == {"twice": lost, "two": lost, "list": lost, "number": {"digest differs"}, "null": {"missing field schema"}, "deep": {"wrong type of inventory"}, "more": {"unknown field x"}, "none": {"digest differs"}, "empty": lost}


def test_trees_tell_what_changed(spark):
    rng = random.Random(1)
    old = {f"k{i}": str(rng.random()) for i in range(700)}
    new = {k: v if rng.random() > 0.02 else v + "!" for k, v in old.items() if rng.random() > 0.02} | {f"n{i}": "x" for i in range(9)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, line string")
    want = {(k, "deleted" if k not in new else "added" if k not in old else "changed") for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    for leaf in (4, 100_000):
        assert set(rows(manifest.changes(frame(old), frame(new), leaf))) == want
    a, b = manifest.tree(frame(old), 2), manifest.tree(frame(new), 2)
    places = {hashlib.sha256(k.encode()).hexdigest()[:2] for k, _ in want}
    assert {r["place"] for r in manifest.differing(a, b, 2).collect()} == places
    assert manifest.differing(a, manifest.tree(frame(dict(reversed(old.items()))), 2), 2).count() == 0
    assert manifest.changes(frame({}), frame({})).count() == 0 and rows(manifest.changes(frame({}), frame({"a": "1"}))) == [("a", "added")]


def test_edits_of_many_sessions(spark):
    groups = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, label string")
    members = spark.createDataFrame([("a", "x/1"), ("a", "x/2"), ("a", "y/3"), ("b", "z")], "id string, path string")
    asked = [(1, "rename", "a", "New"), (2, "move", "x/1", "b"), (3, "merge", "a", "b"), (4, "split", "a", "y"), (5, "delete", "a", None), (6, "move", "z", "a"), (7, "merge", "a", "gone"), (8, "split", "a", "b"), (9, "split", "a", "nowhere"), (10, "move", "lost", "a"), (11, "delete", "c", None)]
    made, warnings = edits.edited(groups, members, spark.createDataFrame(asked, "session int, op string, a string, b string"))
    got = {}
    for r in made.collect():
        got.setdefault(r["session"], {})[r["id"]] = (r["label"], r["files"])
    base = {"a": ("A", 3), "b": ("B", 1), "c": ("C", 0)}
    assert got[1] == base | {"a": ("New", 3)} and got[2] == base | {"a": ("A", 2), "b": ("B", 2)} and got[3] == {"a": ("A", 4), "c": ("C", 0)}
    assert got[4] == base | {"a": ("A", 2), "y": ("y", 1)} and got[5] == {"b": ("B", 1), "c": ("C", 0)} and got[6] == base | {"a": ("A", 4), "b": ("B", 0)}
    assert got[7] == got[8] == got[10] == base and got[9] == base | {"nowhere": ("nowhere", 0)} and got[11] == {"a": ("A", 3), "b": ("B", 1)}
    odd = [(s, f"{op} {a} changes nothing") for s, op, a in ((7, "merge", "a"), (8, "split", "a"), (10, "move", "lost"))]
    assert rows(warnings) == sorted([(5, "files of a have no group"), (6, "b is empty"), (9, "nowhere is empty"), *odd], key=repr)


def test_chains_of_configurations_equal_the_walk(spark):
    configs = {
        "web/tsconfig.json": '{ // mine\n "extends": "../base", "compilerOptions": {"baseUrl": "./src", } }', "base.json": '{"compilerOptions": {"paths": {"@/*": ["./*"], "lib": ["shared/lib.ts"]}, /* c */ }, "extends": "./web/tsconfig"}',
        "own/tsconfig.json": '{"extends": "../base.json", "compilerOptions": {"paths": {"z/*": ["../up/*"]}}}', "bad/tsconfig.json": "{broken", "pkg/tsconfig.json": '{"extends": "@scope/base"}', "lost/tsconfig.json": '{"extends": "./none"}',
    }
    starts = [n for n in configs if n.endswith("tsconfig.json")]
    got = inv.config_patterns(spark.createDataFrame(list(configs.items()), "path string, text string"), spark.createDataFrame([(n,) for n in starts], "start string"))
    want = [(n, r["ord"], r["pattern"], r["exact"], r["targets"]) for n in starts for r in inv.alias_patterns(configs, n)]
    assert rows(got) == sorted(want, key=repr) and len(want) == 3


def test_specs_with_faults(spark):
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "b"), (5, "c")], "ord int, id string")
    entries = spark.createDataFrame([(1, "glob", "x/**"), (2, "file", "y"), (3, "file", "../z"), (4, "glob", "/etc/*"), (4, "file", "w")], "ord int, kind string, entry string")
    assert {tuple(r) for r in validate.group_specs(groups, entries).select("rule", F.col("what")).collect()} == {("id missing", "3"), ("id repeated", "a"), ("globs or files", "4"), ("globs or files", "5"), ("unsafe entry", "3 ../z"), ("unsafe entry", "4 /etc/*")}
