"""Operators on small inputs against plain versions of them."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import assign, graph, qlog, ranking, scoring
from archlens.sources import extract


def plain_search(edges, start, depth):
    """First in, first out over sorted neighbours."""
    near = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    chain, queue = {start: [start]}, deque([start])
    while queue:
        x = queue.popleft()
        if len(chain[x]) > depth:
            continue
        for y in near.get(x, []):
            if y not in chain:
                chain[y] = [*chain[x], y]
                queue.append(y)
    return chain


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_fifo_in_any_order(spark, seed):
    rng = random.Random(seed)
    nodes = [chr(97 + i) for i in range(12)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(28)]
    frame = spark.createDataFrame([(a, b, "import") for a, b in edges] + [("a", "zz", "realtime")], "src string, dst string, type string")
    starts = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, id string")
    for pairs in (graph.adjacency(frame), graph.adjacency(frame.orderBy(F.desc("dst")).repartition(5))):
        got = {(r["qid"], r["id"]): r["chain"] for r in graph.search(starts, pairs, 4).collect()}
        want = {(q, k): v for q, s in ((1, "a"), (2, "b")) for k, v in plain_search(edges, s, 4).items()}
        assert got == want


@pytest.fixture(params=["arrays", "joins"])
def way(request, monkeypatch):
    """Both ways of the graph operators: a graph that is broadcast, and one that is not."""
    if request.param == "joins":
        monkeypatch.setattr(graph, "LOCAL_PAIRS", -1)
    return request.param


def test_search_both_ways(spark, way):
    rng = random.Random(4)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)]
    pairs = spark.createDataFrame(edges + edges[:5], "src string, dst string")
    starts = spark.createDataFrame([(1, "n01"), (1, "n00"), (2, "alone"), (3, "n05"), (4, "alone")], "qid long, id string")
    targets = spark.createDataFrame([(3, "n20"), (3, "n05"), (4, "alone"), (1, "n39")], "qid long, id string")
    avoid = spark.createDataFrame([(1, "n02"), (3, "n07")], "qid long, id string")
    got = sorted((r["qid"], r["id"], r["depth"], tuple(r["chain"])) for r in graph.search(starts, pairs, avoid=avoid).collect())
    near = {}
    for x, y in sorted(set(edges)):
        near.setdefault(x, []).append(y)
    want = []
    for q, seeds, out in ((1, ["n00", "n01"], "n02"), (2, ["alone"], None), (3, ["n05"], "n07"), (4, ["alone"], None)):
        chain, queue = {s: (s,) for s in seeds}, deque(seeds)
        while queue:
            x = queue.popleft()
            for y in near.get(x, []):
                if y not in chain and y != out:
                    chain[y] = (*chain[x], y)
                    queue.append(y)
        want += [(q, k, len(v) - 1, v) for k, v in chain.items()]
    assert got == sorted(want)
    found = graph.search(starts, pairs, targets=targets).collect()
    assert max(r["depth"] for r in found if r["qid"] == 3) == 0 and [r["depth"] for r in found if r["qid"] == 4] == [0]
    assert graph.search(starts, pairs.where("false")).count() == 5 and graph.search(starts.where("false"), pairs).count() == 0


def test_components_and_layers(spark, way):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "e"), ("f", "f"), ("h", "i"), ("i", "h"), ("i", "a")]
    pairs = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefghi"], "id string")
    got = {r["id"]: (r["component"], r["column"]) for r in graph.layering(nodes, pairs).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 2), "e": ("e", 3), "f": ("f", 0), "g": ("g", 0), "h": ("h", 0), "i": ("h", 0)}
    assert {(r["src"], r["dst"]) for r in graph.closure(pairs).collect()} >= {("a", "a"), ("a", "e"), ("f", "f"), ("h", "e")}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_mutual_reach(spark, way, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(30)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)}
    reach = {x: set(plain_search(edges, x, 99)) for x in nodes}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = {r["id"]: r["component"] for r in graph.strong_components(spark.createDataFrame([(x,) for x in nodes], "id string"), frame).collect()}
    assert got == want


@pytest.mark.parametrize(
    "path, glob, want",
    [("app/x/y.py", "app/**", True), ("apple/x", "app/**", False), ("app/x.py", "app/*.py", True), ("app/x/y.py", "app/*.py", False), ("App/x.py", "app/*.py", False), ("a1", "a[0-9]", True), ("aX", "a[!0-9]", True), ("a+b", "a+b", True), ("app/[id]/p.ts", "app/[[]id]/p.ts", True)],
)
def test_globs(spark, path, glob, want):
    assert spark.range(1).select(assign.matches(F.lit(path), glob).alias("x")).first()["x"] is want


@pytest.mark.parametrize(
    "text, want",
    [("SQLite parseHTTPUrl x", ["sq", "lite", "sqlite", "parse", "http", "url", "parsehttpurl"]), ("MAX_SIZE a1 B", ["max", "size", "a1"]), (None, [])],
)
def test_builder_tokens(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(T.builder_tokens(F.col("t")).alias("x")).first()
    assert row["x"] == want


@pytest.mark.parametrize(
    "question, want",
    [
        ("Where's the API layer?", ("LOCATE", "where is the api layer", None, None)),
        ("How does ui reach storage?", ("PATH", None, "ui", "storage")),
        ("show me the route from a to b", ("PATH", None, "a", "b")),
        ("path to x", ("PATH", None, None, None)),
        ("route handlers", ("LOCATE", "route handlers", None, None)),
        ("What depends on auth?", ("DOWNSTREAM", "auth", None, None)),
        ("what does auth depend on", ("UPSTREAM", "auth", None, None)),
        ("what would break if db changed", ("DOWNSTREAM", "db", None, None)),
    ],
)
def test_grammar(spark, question, want):
    q = T.normalize_question(F.col("t"))
    row = spark.createDataFrame([(question,)], "t string").select(T.intent(q).alias("i")).select("i.op", "i.target", "i.from", "i.to").first()
    assert tuple(row) == want


def test_decision_never_guesses(spark):
    """(qid, idx, score, coverage, tier, missing) of the rows of each text, and what is decided."""
    rows = [
        (1, 1, 60.0, 1.0, "path", False), (2, 1, 40.0, 1.0, "stem", False), (2, 2, 40.0, 1.0, "stem", False), (3, 1, 18.0, 1.0, "fuzzy", False), (4, 1, 0.0, 0.0, "none", True),
        (5, 1, 50.0, 1.0, "stem", True), (6, 1, 40.0, 0.5, "stem", False), (7, 1, 40.0, 1.0, "stem", False), (7, 2, 39.5, 1.0, "stem", False), (8, 1, 40.0, 1.0, "stem", False), (8, 2, 20.0, 1.0, "partial", False),
    ]
    df = spark.createDataFrame([(q, i, f"n{i}", s, s, c, t, t == "path", "filename", m, "file") for q, i, s, c, t, m in rows], "qid int, idx long, id string, score double, evidence double, coverage double, tier string, exact boolean, mode string, missing boolean, branch string")
    texts = spark.createDataFrame([(q,) for q in range(1, 10)], "qid int")
    got = {r["qid"]: (r["label"], r["choice"] if r["yes"] else None, r["suggestions"]) for r in scoring.heads(texts, scoring.finished(df)).collect()}
    choice, none = "Needs your choice", ("No match", None, [])
    assert got == {1: ("Exact match", "n1", ["n1"]), 2: (choice, None, ["n1", "n2"]), 3: (choice, None, ["n1"]), 4: none, 5: (choice, None, ["n1"]), 6: none, 7: (choice, None, ["n1", "n2"]), 8: ("Likely match", "n1", ["n1", "n2"]), 9: none}


def test_misspellings_meet_by_pieces(spark):
    """Names at most two edits apart that may pass for a misspelling: what meets by equal pieces is all that a comparison of all finds."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcd", k=rng.randrange(3, 14))) for _ in range(60)]
    for w in list(words):
        x = list(w)
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randrange(0, 2)] = rng.choice(["a", "e", ""])
        words.append("".join(x))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    names = sorted({w for w in words if w})
    want = {(a, b, edits(a, b)) for a in names for b in names if len(a) >= 5 and len(b) >= 3 and 0 < edits(a, b) <= (1 if len(a) < 8 else 2) and edits(a, b) / max(len(a), len(b)) <= 0.2}
    frame = spark.createDataFrame([(n,) for n in names], "a string")
    assert {(r["a"], r["b"], r["d"]) for r in scoring.near_names(frame, frame.withColumnRenamed("a", "b")).collect()} == want and want
    close = {(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= 2}
    assert {(r["name"], r["other"], r["d"]) for r in ranking.close_words(frame.withColumnRenamed("a", "name")).collect()} == close


def test_concept_search_needs_every_word(spark):
    docs = spark.createDataFrame([(f"f{i:02}", f"name{i}", f"src/name{i}.py", "fills space") for i in range(39)] + [("z", "zoo", "src/zoo.py", "zebra stripes live in storage")], "id string, name string, path string, docstring string")
    asked = spark.createDataFrame([(1, "where are zebra stripes in storage?"), (2, "zebra unicorn"), (3, "")], "qid int, question string")
    got = ranking.bm25(docs, asked).collect()
    assert [(r["qid"], r["id"], r["rank"]) for r in got] == [(1, "z", 1)]


def test_log_fold_drops_early_verdicts_and_resets(spark):
    rows = [("e1", "verdict", "match", 1), ("e1", "question", None, 2), ("e1", "verdict", "unsure", 3), ("e2", "question", None, 4), ("e2", "verdict", "match", 5), ("e2", "question", None, 6), ("e3", "verdict", "match", 7)]
    df = spark.createDataFrame(rows, "entry_id string, kind string, label string, seq long").withColumn("at", F.current_timestamp())
    assert {(r["entry_id"], r["verdict"]) for r in qlog.folded(df).collect()} == {("e1", "unsure"), ("e2", None)}


def test_stream_equals_batch(spark):
    from archlens.plans.registry import QUERIES

    data = "/root/testdata/sf0.001"
    key = lambda df: sorted((r["entry_id"], r["seq"], r["verdict"] or "") for r in df.collect())
    assert key(QUERIES["log_stream"](spark, data)) == key(QUERIES["log_fold"](spark, data))


def test_log_lines_are_read_leniently(spark, tmp_path):
    from archlens.streaming.question_log import read_lines

    (tmp_path / "log.jsonl").write_text('{"entry_id": 1, "kind": "question", "seq": 1}\n{"entry_id": 2, "ki\nnot json\n{"entry_id": 3, "kind": "other", "seq": 2}\n' + '{"entry_id": 4, "kind": "verdict", "seq": 3, "label": "' + "x" * 200_000 + '"}\n')
    assert [r["entry_id"] for r in read_lines(spark, str(tmp_path)).collect()] == [1]


def test_files_that_do_not_parse(spark):
    facts = extract.python_facts(spark.createDataFrame([("x.py", "def ("), ("y.py", None)], "path string, text string"))
    assert [r["fact"] for r in facts.collect()] == ["unparsed"]


def test_long_strings_and_comments_do_not_break_the_scan(spark):
    text = "'" + "a\\'" * 20_000 + "'\n/*" + "x" * 300_000 + "*/\nimport './real'\n" + "`" + "\\`" * 20_000 + "import './no'`"
    got = extract.js_specifiers(spark.createDataFrame([("a.ts", text)], "path string, text string")).collect()
    assert [r["spec"] for r in got] == ["./real"]


@pytest.mark.parametrize(
    "bases, cls, want",
    [
        ({"O": [], "A": ["O"], "B": ["O"], "C": ["A", "B"]}, "C", ["C", "A", "B", "O"]),
        ({"A": [], "B": ["A"], "C": ["A", "B"]}, "C", None),
        ({"A": ["B"], "B": ["A"]}, "A", None),
        ({"A": [None]}, "A", None),
        ({"O": [], "X": ["O"], "Y": ["O"], "Z": ["O"], "P": ["X", "Y"], "Q": ["Y", "Z"], "R": ["P", "Q"]}, "R", ["R", "P", "X", "Q", "Y", "Z", "O"]),
    ],
)
def test_linear_order(bases, cls, want):
    assert extract.linear_order(cls, bases) == want


def test_linear_order_equals_the_interpreter():
    rng = random.Random(1)
    for _ in range(200):
        bases, classes = {}, {}
        for i in range(7):
            above = rng.sample(list(classes), min(len(classes), rng.randrange(0, 4)))
            bases[f"c{i}"] = above
            try:
                classes[f"c{i}"] = type(f"c{i}", tuple(classes[b] for b in above), {})
            except TypeError:
                assert extract.linear_order(f"c{i}", bases) is None
                break
            assert extract.linear_order(f"c{i}", bases) == [c.__name__ for c in classes[f"c{i}"].__mro__[:-1]]


def test_first_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("d", "e"), ("c", "a"), ("e", "b"), ("b", "c")], "src string, dst string")
    assert [r["id"] for r in graph.first_cycle(edges).orderBy("step").collect()] == ["a", "b", "c", "a"]
    assert graph.first_cycle(edges.where("src = 'a'")).count() == 0


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("g", 4, 2), ("h", 1, 99)], "g string, o int, n int")
    got = graph.within_budget(rows, "g", "o", "n", 10).where("kept").collect()
    assert sorted((r["g"], r["o"]) for r in got) == [("g", 1), ("g", 3)]
