"""Sources, sinks, checks, edits and the engine's verbs on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from archlens.engine import Engine
from archlens.operators import edits, validate
from archlens.sources import inventory as inv
from archlens.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tree_listing(spark):
    h = "a" * 40
    raw = spark.createDataFrame([(f"100644 blob {h}      12\tsrc/a b.py\x00120000 blob {h} 3\tlink\x00160000 commit {h} -\tsub\x00100644 blob {h} 1\tSRC/A B.py\x00100644 blob {h} 1\t../x\x00junk\x00100644 blob {h} 3\tlink\x00",)], "listing string")
    tree = inv.tree_listing(raw)
    assert ("src/a b.py", "100644", "blob", h, 12, True) in rows(tree) and ("sub", "160000", "commit", h, None, True) in rows(tree)
    assert {(r["rule"]) for r in inv.listing_violations(tree, 3).collect()} == {"duplicate", "portable collision", "malformed", "unsafe path", "too many members"}
    assert inv.listing_violations(tree.where("path = 'sub'")).count() == 0


def test_a_listing_has_no_rule_on_members_where_none_is_set(spark):
    """As `tree_violations` asks, whose SQL knows no greatest number."""
    tree = inv.records(spark.createDataFrame([(f"100644 blob {'a' * 40} 1\tf{i}.py",) for i in range(3)], "r string"))
    assert rows(inv.listing_violations(tree, 2)) == [("too many members", "3")] and rows(inv.listing_violations(tree, None)) == []


def test_worker_refuses_a_long_text_in_a_broken_line(spark, tmp_path):
    """The query cuts every third line; where its text is too long, that comes first."""
    from archlens.plans.library import worker_replies

    said = [(i, turn, "user", "x" * n) for i, (turn, n) in enumerate([(0, 2001), (1, 2001), (2, 2001), (1, 2000), (4, 3)])]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["kind"], r["reply"]): r["n"] for r in worker_replies(spark, str(tmp_path)).collect()}
    assert got == {(0, "too long"): 1, (1, "too long"): 1, (2, "too long"): 1, (1, "not JSON"): 2}


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "a.py").write_text("x = 1\ny = 2")
    (tmp_path / "app" / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "c.js").write_text("x")
    blobs = inv.read_blobs(spark, str(tmp_path))
    got = {r["path"]: (r["content_kind"], r["line_count"], r["status"], r["reason"]) for r in inv.inventory(blobs).collect()}
    assert got == {"app/a.py": ("text", 2, "included", None), "app/b.bin": ("binary", None, "skipped", "binary"), "dist/c.js": ("text", 1, "included", None)}
    assert [r["path"] for r in inv.source_files(blobs).collect()] == ["app/a.py"]


def test_configuration_chain():
    configs = {
        "web/tsconfig.json": '{ // mine\n "extends": "../base", "compilerOptions": {"baseUrl": "./src", } }',
        "base.json": '{"compilerOptions": {"paths": {"@/*": ["./*"], "lib": ["shared/lib.ts"], "url": ["http://x/*"]}, /* c */ }, "extends": "./web/tsconfig"}',
    }
    got = inv.alias_patterns(configs, "web/tsconfig.json")
    assert [(r["pattern"], r["exact"], r["targets"]) for r in got] == [("@/*", False, ["web/src/*"]), ("lib", True, ["web/src/shared/lib.ts"]), ("url", True, ["web/src/http:/x/*"])]
    assert inv.alias_patterns({"tsconfig.json": "{broken"}) == [] and inv.alias_patterns({}) == []


def test_plain_json(spark):
    text = '{"a": "// no", /* c */ "b": [1, 2,], // x\n}'
    out = spark.createDataFrame([(text,)], "t string").select(inv.plain_json(F.col("t")).alias("x")).first()["x"]
    assert json.loads(out) == {"a": "// no", "b": [1, 2]}


def test_eval_cases_and_projects(spark):
    cases = spark.createDataFrame([("1", "q", "LOCATE", "a"), ("1", "q", "LOCATE", "a"), ("2", " ", "PATH", None), ("3", "q", "ODD", "zz")], "id string, question string, operation string, target string")
    nodes = spark.createDataFrame([("a",)], "id string")
    assert rows(inv.eval_cases(cases, nodes)) == [("1", "repeated id"), ("2", "empty question"), ("3", "unknown operation"), ("3", "unknown target")]
    index = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2), ("q", "s3", 1)], "project_id string, snapshot_id string, imported_at int")
    assert rows(inv.projects(index)) == [("p", "s2", 2), ("q", "s3", 1)]


def test_excerpts(spark):
    text = "one\ntwo\nthree\nfour"
    src = spark.createDataFrame([("a", text), ("b", text)], "path string, text string").withColumn("sha256", F.when(F.col("path") == "a", F.sha2("text", 256)).otherwise("0"))
    want = src.select("path", "sha256", F.lit(2).alias("start"), F.lit(4).alias("end"))
    assert rows(inv.excerpts(src, want, most_lines=2)) == [("a", 2, "two", True), ("a", 3, "three", True)]
    assert rows(inv.excerpts(src, want, most_bytes=1000))[-1] == ("a", 4, "four", False)


@pytest.mark.parametrize("url, want", [("https://github.com/o/r.git", "o/r"), ("git@github.com:o/r.git", "o/r"), ("ssh://git@host.io:22/a/b/", "host.io/a/b"), ("/local/x", None)])
def test_repository_identity(spark, url, want):
    assert spark.range(1).select(inv.repository_identity(F.lit(url)).alias("x")).first()["x"] == want


def test_publish_is_all_or_nothing(spark, tmp_path):
    good, none = spark.createDataFrame([(1, "a")], "n int, s string"), spark.createDataFrame([], "rule string, what string")
    bad = spark.createDataFrame([("cycle", "a b")], "rule string, what string")
    root = str(tmp_path / "pub")
    with pytest.raises(sinks.Rejected):
        sinks.publish({"t": good}, root, "s1", bad)
    assert not (tmp_path / "pub").exists()
    receipt = sinks.publish({"t": good}, root, "s1", none)
    assert sinks.publish({"t": good.union(good)}, root, "s1", none) == receipt and sinks.verify(spark, root, "s1").count() == 0
    assert rows(spark.read.parquet(f"{root}/snapshot_id=s1/t")) == [(1, "a")]
    good.union(good).write.mode("overwrite").parquet(f"{root}/snapshot_id=s1/t")
    assert rows(sinks.verify(spark, root, "s1")) == [("t",)]


def test_stores(spark, tmp_path):
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, at int, v string")
    assert rows(sinks.latest(log, ["key"], ["at"])) == [("j", 1, "only"), ("k", 2, "new")]
    stored = spark.createDataFrame([("1", "dev", "a"), ("2", "holdout", "b")], "id string, split string, v string")
    fresh = spark.createDataFrame([("1", "dev", "A"), ("2", "holdout", "B"), ("3", "dev", "C")], "id string, split string, v string")
    assert rows(sinks.merge_feedback(stored, fresh)) == [("1", "dev", "A"), ("2", "holdout", "b"), ("3", "dev", "C")]
    cache = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 10, 3)], "key string, size int, at int")
    assert [r["key"] for r in sinks.evict(cache, "size", "at", "key", 2, 100, "a").orderBy("key").collect()] == ["a", "c"]
    sinks.append_log(stored, str(tmp_path / "log"))
    sinks.append_log(stored, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_once(stored, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(stored, str(tmp_path / "once"))
    told = spark.createDataFrame([("p", "c1", "e", "q", "LOCATE", "match"), ("p", "c2", "f", "q", "LOCATE", None)], "project_id string, commit string, entry_id string, query string, operation string, verdict string")
    with pytest.raises(ValueError):
        sinks.export_reviews(told)
    assert sinks.export_reviews(told.limit(1)).count() == 1


def graph_tables(spark):
    nodes = spark.createDataFrame([("L", "layer", None), ("a", "file", "L"), ("b", "file", "L")], "id string, kind string, layer string")
    edges = spark.createDataFrame([("a", "b", "import")], "src string, dst string, type string")
    return nodes, edges


def test_snapshot_checks_name_each_mutation(spark):
    nodes, edges = graph_tables(spark)
    add = lambda df, *r: df.unionByName(spark.createDataFrame(list(r), df.schema))
    check = lambda n, e: {r["rule"] for r in validate.snapshot(n, e).collect()}
    assert check(nodes, edges) == set()
    assert check(add(nodes, ("a", "file", "L")), edges.where("false")) == {"duplicate node"}
    assert check(add(nodes, ("c", "file", "M")), edges) == {"unknown owner"}
    for edge, want in ((("a", "b", "import"), "duplicate edge"), (("a", "z", "import"), "dangling edge"), (("a", "L", "import"), "mixed edge"), (("b", "a", "odd"), "unknown type"), (("b", "a", "manual"), "file type")):
        assert want in check(nodes, add(edges, edge))


def test_other_checks(spark):
    good = spark.createDataFrame([("x", None, 0), ("x/y", "x", 1)], "label string, parent string, depth int")
    assert validate.folders(good).count() == 0
    bad = spark.createDataFrame([("x/y", "z", 2), ("x/y", "x", 1)], good.schema)
    assert {r["rule"] for r in validate.folders(bad).collect()} == {"duplicate folder", "wrong parent", "wrong depth", "missing parent"}
    sym = spark.createDataFrame([("f", "p", 1, 5), ("g", "p", 6, 99)], "id string, path string, start int, end int")
    sites = spark.createDataFrame([("f", "g", "p", 3), ("f", "h", "p", 9), ("q", "f", "p", 1)], "src string, dst string, path string, line int")
    lines = spark.createDataFrame([("p", 10)], "path string, line_count int")
    assert {r["rule"] for r in validate.symbols(sym, sites, lines).collect()} == {"range", "site outside caller", "unknown callee", "unknown caller"}
    assert validate.group_spec([{"id": "a", "globs": ["x/**"]}, {"id": "a", "files": ["../y"], "globs": []}]) == ["id 'a'", "a: globs or files", "a: '../y'"]
    cited = spark.createDataFrame([("e", "s1", True, None), ("e", "s2", False, None), ("e", "s3", False, "w")], "explanation_id string, statement string, inferred boolean, evidence_id string")
    assert rows(validate.explanations(cited, spark.createDataFrame([("v",)], "evidence_id string"))) == [("neither cited nor inferred", "e s2"), ("unknown evidence", "e w")]
    assert validate.same_rows(good, good.withColumn("depth", F.col("depth") + 1), ("depth",)).count() == 0
    heads = spark.createDataFrame([(1, 1, 2.0, 0.5), (1, 2, 3.0, 0.4)], "qid int, rank int, score double, p double")
    assert {r["rule"] for r in validate.scores(heads).collect()} == {"sum", "order"}


def test_packets(spark):
    nodes, edges = graph_tables(spark)
    schema = "request_id string, status string, selected array<string>, witnesses array<array<string>>, alternatives array<string>, limitations array<string>, truncated boolean, continuation string"
    make = lambda *r: spark.createDataFrame([r], schema)
    check = lambda p: {r["rule"] for r in validate.packets(p, nodes, edges).collect()}
    assert check(make("1", "matched", ["a", "b"], [["a", "b"]], [], [], False, None)) == set()
    assert check(make("1", "odd", ["z"], [["b", "a"]], [], [], True, None)) == {"unknown status", "unknown node", "hop is no edge", "truncated without continuation"}
    assert check(make("1", "matched", [], [], [], [], False, None)) == {"matched without nodes"}
    assert check(make("1", "no-match", ["a"], [], [], [], False, None)) == {"nodes where none may be"}
    assert check(make("1", "unsupported", [], [], ["a"] * 21, [], False, None)) == {"unsupported without reason", "too many", "alternative twice"}
    full = schema + ", operation string, highlight string, seed string, edges array<struct<src string, dst string, type string>>"
    make = lambda *r: spark.createDataFrame([("1", "matched", ["a", "b"], [["a", "b"]], [], [], False, None, *r)], full)
    kind = edges.where("src = 'a' and dst = 'b'").first()["type"]
    assert check(make("PATH", "relevant", "a", [("a", "b", kind)])) == set()
    assert check(make(None, "odd", "a", [("b", "a", kind)])) == {"unknown operation", "unknown highlight", "edge not observed"}


def test_edits():
    spec = [{"id": "a", "files": ["x/1.py", "y/2.py"]}, {"id": "b", "files": ["z/3.py"]}, {"id": "g", "globs": ["q/**"]}]
    assert edits.rename(spec, "a", "A")[0][0]["label"] == "A" and "label" not in spec[0]
    moved, warn = edits.move(spec, "z/3.py", "a")
    assert moved[0]["files"] == ["x/1.py", "y/2.py", "z/3.py"] and warn == ["b is empty"]
    assert edits.move(spec, "z/3.py", "g")[1] and edits.merge(spec, "a", "g")[1]
    assert edits.merge(spec, "a", "b")[0] == [{"id": "a", "files": ["x/1.py", "y/2.py", "z/3.py"]}, spec[2]]
    parted, warn = edits.split(spec, "a", "x/**", "n")
    assert [g["id"] for g in parted] == ["a", "n", "b", "g"] and parted[1]["files"] == ["x/1.py"] and not warn
    assert edits.delete(spec, "b") == ([spec[0], spec[2]], ["files of b have no group"])


def test_engine_answers(spark):
    paths = ["app/a.py", "app/b.py", "lib/c.py", "lib/util.py", "app/util.py"]
    nodes = spark.createDataFrame([(p, "file", p) for p in paths], "id string, kind string, path string")
    edges = spark.createDataFrame([("app/a.py", "app/b.py", "import"), ("app/b.py", "lib/c.py", "http"), ("app/a.py", "lib/c.py", "realtime")], "src string, dst string, type string")
    calls = spark.createDataFrame([("f", "g", "resolved"), ("h", "g", "typed")], "src string, dst string, confidence string")
    engine = Engine(nodes, edges, calls=calls)
    asked = spark.createDataFrame([(1, "What depends on lib/c.py?"), (2, "dependencies of a.py"), (3, "where is util"), (4, "How does a reach c?"), (5, "from c to a"), (6, "where is nowhere.py"), (7, "Where is app/b.py?")], "qid long, question string")
    got = {}
    for r in engine.answer(asked).collect():
        got.setdefault(r["qid"], []).append((r["op"], r["status"], r["id"], r["chain"], r["alternatives"]))
    assert sorted(got[1]) == [("DOWNSTREAM", "matched", "app/a.py", "app/a.py>app/b.py>lib/c.py", None), ("DOWNSTREAM", "matched", "app/b.py", "app/b.py>lib/c.py", None)]
    assert sorted(x[2] for x in got[2]) == ["app/b.py", "lib/c.py"]
    assert got[3] == [("LOCATE", "needs-choice", None, None, "app/util.py,lib/util.py")]
    assert got[4] == [("PATH", "matched", "lib/c.py", "app/a.py>app/b.py>lib/c.py", None)]
    assert got[5] == [("PATH", "no-path", None, None, None)] and got[6][0][1] == "no-match" and got[7][0][2] == "app/b.py"
    who = spark.createDataFrame([(1, "g")], "qid long, id string")
    assert rows(engine.callers(who)) == [(1, "f", "resolved"), (1, "h", "typed")] and rows(engine.callers(who, certain=True)) == [(1, "f", "resolved")]


def test_engine_answers_about_definitions(spark):
    symbols = spark.createDataFrame([("m#a", "a"), ("m#b", "b"), ("m#c", "c"), ("n#c", "c"), ("m#d", "d")], "id string, name string")
    calls = spark.createDataFrame([("m#a", "m#b", "resolved"), ("m#b", "m#d", "typed"), ("m#b", "m#b", "resolved"), ("m#d", "n#c", "resolved")], "src string, dst string, confidence string")
    engine = Engine(spark.createDataFrame([], "id string, kind string, path string"), calls.select("src", "dst").withColumn("type", F.lit("call")), symbols=symbols, calls=calls)
    asked = ["trace from a", "who calls d?", "what does b call", "how does a reach d", "how does d reach a", "where is c defined", "callers of nothing", "where is the api"]
    got = {}
    for r in engine.answer_symbols(spark.createDataFrame(list(enumerate(asked)), "qid int, question string")).collect():
        got.setdefault(r["qid"], []).append((r["status"], r["id"], r["chain"], r["tier"], r["alternatives"]))
    assert sorted(got[0]) == [("matched", "m#b", "m#a>m#b", "resolved", None), ("matched", "m#d", "m#a>m#b>m#d", "typed", None), ("matched", "n#c", "m#a>m#b>m#d>n#c", "typed", None)]
    assert got[1] == [("matched", "m#b", "m#b", "typed", None)] and {x[1] for x in got[2]} == {"m#b", "m#d"}
    assert got[3] == [("matched", "m#d", "m#a>m#b>m#d", "typed", None)] and got[4] == [("no-path", None, None, None, None)]
    assert got[5] == [("needs-choice", None, None, None, "m#c,n#c")] and got[6] == [("no-match", None, None, None, None)] and 7 not in got
    assert [r["id"] for r in engine.trace(spark.createDataFrame([(1, "m#a")], "qid int, id string"), certain=True).collect()] == ["m#b"]
