"""Whole answers on a small map: every kind of question, caps and pages, and rules for packets."""

import pytest
from pyspark.sql import functions as F

from archlens.engine import Engine
from archlens.operators import packets, validate


@pytest.fixture(scope="module")
def engine(spark):
    paths = ["app/a.py", "app/b.py", "lib/c.py", "lib/util.py", "app/util.py"] + [f"many/f{i:03}.py" for i in range(260)]
    nodes = [(p, "file", p, p.rpartition("/")[2], []) for p in paths] + [("core", "layer", "", "Core services", ["engine room"]), ("edge", "layer", "", "Edge", [])]
    edges = [("app/a.py", "app/b.py", "import"), ("app/b.py", "lib/c.py", "http"), ("app/b.py", "lib/c.py", "import"), ("app/a.py", "lib/c.py", "realtime"), ("edge", "core", "import")]
    edges += [(f"many/f{i:03}.py", "lib/util.py", "import") for i in range(260)]
    symbols = [("m#run", "run", "run", "app/a.py"), ("n#run", "run", "run", "app/b.py"), ("m#stop", "stop", "stop", "app/a.py"), ("m#go", "go", "go", "app/a.py")]
    calls = [("m#go", "m#stop", "typed"), ("m#stop", "m#stop", "resolved"), ("m#stop", "n#run", "resolved")]
    frame = spark.createDataFrame
    return Engine(
        frame(nodes, "id string, kind string, path string, label string, aliases array<string>"), frame(edges, "src string, dst string, type string"), symbols=frame(symbols, "id string, name string, qualname string, path string"),
        calls=frame(calls, "src string, dst string, confidence string"), inventory=frame([(p, "0" * 64) for p in paths], "path string, sha256 string"),
        search_text=frame([("lib/c.py", "c", "lib/c.py", "zebra stripes in cold storage")] + [(p, "x", p, "fills space") for p in paths if p != "lib/c.py"], "id string, name string, path string, docstring string"),
    )


QUESTIONS = [
    (1, "What depends on lib/c.py?", 0), (2, "dependencies of a.py", 0), (3, "where is util", 0), (4, "from a.py to c.py", 0), (5, "from c.py to a.py", 0), (6, "where is nowhere.py", 0), (7, "What depends on lib/util.py?", 0), (8, "What depends on lib/util.py?", 199),
    (9, "who calls m#stop", 0), (10, "trace from go", 0), (11, "what does run call", 0), (12, "how does go reach stop", 0), (13, "path between core and lib/c.py", 0), (14, "what depends on the engine room", 0), (15, "path to nothing", 0), (16, "callers of lib/c.py", 0),
    (17, "zebra stripes in storage", 0), (18, "callees of go", 0),
]


def test_every_kind_of_question(spark, engine):
    asked = spark.createDataFrame(QUESTIONS, "qid long, question string, offset int")
    told = engine.answer_packets(asked).cache()
    got = {r["request_id"]: r for r in told.collect()}
    short = lambda n: (got[n]["operation"], got[n]["status"], list(got[n]["selected"]))
    assert short(1) == ("DOWNSTREAM", "matched", ["lib/c.py", "app/b.py", "app/a.py"]) and got[1]["witnesses"][1] == ["app/a.py", "app/b.py", "lib/c.py"]
    assert [tuple(e) for e in got[1]["edges"]] == [("app/b.py", "lib/c.py", "http"), ("app/a.py", "app/b.py", "import")] and got[1]["highlight"] == "potential-impact"
    assert [r["path"] for r in got[1]["refs"]] == got[1]["selected"]
    assert short(2) == ("UPSTREAM", "matched", ["app/a.py", "app/b.py", "lib/c.py"]) and got[2]["highlight"] == "relevant"
    assert got[3]["status"] == "needs-choice" and got[3]["alternatives"] == ["app/util.py", "lib/util.py"] and got[3]["requested"] == "LOCATE"
    assert short(4) == ("PATH", "matched", ["app/a.py", "app/b.py", "lib/c.py"]) and short(5) == ("PATH", "no-path", ["lib/c.py", "app/a.py"])
    assert got[6]["status"] == "no-match" and not got[6]["selected"]
    assert len(got[7]["selected"]) == 200 and got[7]["truncated"] and got[7]["continuation"] == "offset:199" and len(got[7]["witnesses"]) == 199
    assert got[8]["selected"] == ["lib/util.py", *[f"many/f{i:03}.py" for i in range(199, 260)]] and not got[8]["truncated"]
    assert short(9) == ("CALLERS", "matched", ["m#stop", "m#go"]) and list(got[9]["confidence"]) == ["typed"] and ("m#stop", "m#stop", "resolved") in [tuple(e) for e in got[9]["edges"]]
    assert short(10)[:2] == ("TRACE", "matched") and got[10]["witnesses"] == [["m#go", "m#stop"], ["m#go", "m#stop", "n#run"]] and list(got[10]["confidence"]) == ["typed", "typed"]
    assert got[11]["status"] == "needs-choice" and got[11]["alternatives"] == ["m#run", "n#run"] and short(12) == ("FLOW", "matched", ["m#go", "m#stop"])
    assert short(13) == ("PATH", "unsupported", []) and short(14) == ("DOWNSTREAM", "matched", ["core", "edge"]) and got[15]["status"] == "no-match"
    assert short(16) == ("DOWNSTREAM", "matched", ["lib/c.py", "app/b.py", "app/a.py"]) and got[17]["alternatives"] == ["lib/c.py"] and short(18) == ("CALLEES", "matched", ["m#go", "m#stop"])
    ids = engine.nodes.select("id").unionByName(engine.symbols.select("id"))
    every = engine.edges.unionByName(engine.calls.select("src", "dst", F.col("confidence").alias("type")))
    assert validate.packets(told.withColumn("request_id", F.col("request_id").cast("string")), ids, every).collect() == []
    shown = {(r["request_id"], r["id"]): r["witness"] for r in packets.node_witnesses(told).collect()}
    assert shown[1, "app/a.py"] == ["app/a.py", "app/b.py", "lib/c.py"] and shown[10, "n#run"] == ["m#go", "m#stop", "n#run"] and (1, "lib/c.py") not in shown


def test_certain_calls_only(spark, engine):
    asked = spark.createDataFrame([(1, "trace from go"), (2, "how does go reach stop")], "qid long, question string")
    got = {r["request_id"]: (r["status"], list(r["selected"])) for r in engine.answer_packets(asked, certain=True).collect()}
    assert got == {1: ("matched", ["m#go"]), 2: ("no-path", ["m#go", "m#stop"])}


def test_folders_stand_for_their_files(spark):
    frame = spark.createDataFrame
    files = ["a/x.py", "a/in/y.py", "b/z.py"]
    nodes = frame([(p, "file", p, p) for p in files] + [("F-a", "layer", "a", "a"), ("F-in", "layer", "a/in", "a/in"), ("F-b", "layer", "b", "b")], "id string, kind string, path string, label string")
    edges = frame([("a/x.py", "a/in/y.py", "import"), ("a/in/y.py", "b/z.py", "import")], "src string, dst string, type string")
    inside = [("F-a", "F-in", "layer", 1), ("F-a", "a/in/y.py", "file", 2), ("F-a", "a/x.py", "file", 3), ("F-in", "a/in/y.py", "file", 1), ("F-b", "b/z.py", "file", 1)]
    engine = Engine(nodes, edges, members=frame(inside, "layer string, id string, kind string, ord int"))
    asked = frame([(1, "what depends on the b folder?"), (2, "dependencies of folder a"), (3, "where is the a folder"), (4, "path from folder a to folder b")], "qid long, question string")
    got = {r["request_id"]: (r["status"], list(r["selected"]), [list(w) for w in r["witnesses"]]) for r in engine.answer_packets(asked).collect()}
    assert got[1] == ("matched", ["F-b", "a/in/y.py", "a/x.py"], [["a/in/y.py", "b/z.py"], ["a/x.py", "a/in/y.py", "b/z.py"]])
    assert got[2] == ("matched", ["F-a", "b/z.py"], [["a/in/y.py", "b/z.py"]])
    assert got[3] == ("matched", ["F-a", "F-in", "a/in/y.py", "a/x.py"], []) and got[4] == ("matched", ["a/in/y.py", "b/z.py"], [["a/in/y.py", "b/z.py"]])
