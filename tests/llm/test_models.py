"""Toxicity and quality by held-out accuracy, and the pipeline against a plain version."""

import os

import numpy as np
import pytest

import corpus_pipeline
from archlens.llm.common import held_out, table
from archlens.llm.folding import fold
from archlens.llm.quality import DEPTH, STATISTICS, grow, quality, statistics
from archlens.llm.toxicity import Model, matcher, toxicity
from tests.llm.helpers import ODD, docs, labels

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_folding():
    assert fold("Ｉd1оt, 1D10T! p4th3t1c 108.51 $tup1d wow!!") == fold("idiot idiot pathetic 108 51 stupid wow")
    assert fold("") == fold("\n ") == "  "


def test_matcher_takes_one_pattern_a_word_and_obeys_exceptions():
    match = matcher(Model({fold("trash"): 2.0, fold("trash")[:-1]: 1.0, fold("tra")[:-1]: 0.5}, (fold("trash can"),), ()))
    assert match(fold("trash trashy trap can")) == ({0: 2.0, 6: 1.0, 13: 0.5}, 4)
    assert match(fold("a trash can, trash")) == ({12: 2.0}, 4)
    assert matcher(Model({}, (), ()))(fold("trash")) == ({}, 1)


@needs_data
@pytest.mark.parametrize("op, label, least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.93)])
def test_held_out_accuracy(spark, op, label, least):
    got = op(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    rows = got.join(table(spark, DATA, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least


@pytest.mark.parametrize("op", [toxicity, quality])
def test_odd_texts_and_labels(spark, op):
    marks = labels(spark, [(i, i % 2, i % 2, None) for i in range(8)] + [(None, 1, 1, ""), (3, None, None, ""), (4, 7, 7, ""), (99, 1, 0, "")])
    got = op(docs(spark, ODD), marks).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert op(docs(spark, ODD), marks.where("false")).count() == len(ODD) and op(docs(spark, []), marks).count() == 0
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1


def test_held_out_fold(spark):
    import zlib

    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    model = grow(x, ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float))

    def walk(row):
        total = model.start
        for t in range(len(model.feature)):
            at = 0
            for _ in range(DEPTH):
                at = int((model.left if row[model.feature[t, at]] <= model.threshold[t, at] else model.right)[t, at])
            total += model.value[t, at]
        return total

    assert np.allclose(model.raw(x), [walk(r) for r in x])
    assert ((model.predict(x) > 0.5) == ((x[:, 0] > 0.3) ^ (x[:, 1] > 0))).mean() > 0.95
    assert len(statistics("A b.\nA b.")) == len(statistics(None)) == len(STATISTICS)


@needs_data
def test_pipeline_stages_take_effect(spark):
    from tests.llm.test_pairs import brute

    docs_, sizes = table(spark, DATA, "documents"), {}
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs_.collect()}
        out = stage(spark, docs_, DATA)
        rows = out.collect()
        sizes[name] = len(rows)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in toxicity(docs_, table(spark, DATA, "labels")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == before.keys() - toxic and toxic
        if name == "quality":
            good = {r["doc_id"] for r in quality(docs_, table(spark, DATA, "labels")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == good and len(good) < len(before)
        if name == "near_dedup":
            want = brute(list(before.items()), 5)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "mixing":
            from archlens.llm import mixing

            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs_).collect()}
            got = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {i: n for i, n in want.items() if n}
        if name == "packing":
            assert {r["doc_id"] for r in rows} == before.keys()
            continue
        assert out.columns == columns
        docs_ = spark.createDataFrame(rows, docs_.schema)


def test_pipeline_stands_odd_rows(spark):
    marks = labels(spark, [(i, 1, 0, None) for i in range(8)])
    rows = docs(spark, [*ODD, (4, "one", "b")])
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        marks.write.parquet(f"{d}/labels.parquet")
        at, kept = rows, []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, d)
            kept.append(sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in at.collect()))
            assert at.columns == rows.columns
        assert kept[0] == kept[1] == [-1, 1, 2, 3, 4, 4, 4, 5, 6, 7, 8, 9, 11] and kept[2] == [-1, 1, 2, 3, 4, 6, 7, 8, 9, 11]
        assert corpus_pipeline.STAGES[-1][1](spark, at, d).count() > 0
        empty = docs(spark, [])
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, d)
            assert empty.count() == 0


def plain_match(folded, model):
    """Sum and number of the heaviest patterns of words outside exception phrases, by looking at every place."""
    inside, best = set(), {}
    for p in model.exceptions:
        for at in range(len(folded)):
            if folded.startswith(p, at):
                inside |= set(range(at, at + len(p) - 1))
    for p, w in model.lexicon.items():
        for at in range(len(folded)):
            if folded.startswith(p, at) and at not in inside:
                best[at] = max(w, best.get(at, 0))
    return sum(best.values()), len(best), len(folded.split())


def test_toxicity_equals_a_plain_matcher(spark):
    """The whole query on a small fixture: learned lexicon, exceptions and scores against loops over every place of every text."""
    import math
    import random

    from archlens.llm.toxicity import fit, patterns_of, phrases_of, weight

    rng, rows, marks = random.Random(3), [], []
    plain_words = [f"word{i}" for i in range(60)]
    for i in range(400):
        words = rng.choices(plain_words, k=rng.randrange(5, 40))
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "1d10t", "idіots"])
        elif i % 80 == 1:
            words[2:2] = ["idiot", "savant"]
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic), None))
    frame, marked = docs(spark, rows), labels(spark, marks)
    model = fit(frame, marked)
    import zlib

    learn = [(fold(t), m[2]) for (i, t), m in zip(rows, marks, strict=True) if zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(y for _, y in learn), sum(1 - y for _, y in learn)
    want = {}
    for p in {p for t, y in learn if y for p in patterns_of(t)}:
        a, b = (sum(p in patterns_of(t) for t, y in learn if y == c) for c in (1, 0))
        if a >= max(3, math.ceil(n1 / 250)) and weight(a, b, n1, n0) >= 2.5:
            want[p] = round(weight(a, b, n1, n0), 4)
    assert model.lexicon == want and any("idiot" in p for p in want)
    bare = Model(want, (), ())
    places = lambda t: {at for at in range(len(t)) if any(t.startswith(p, at) for p in want)}
    seen = [(phrases_of(t, places(t)), y) for t, y in learn]
    harmless = set()
    for p in {p for s, _ in seen for p in s}:
        a, b = (sum(p in s for s, y in seen if y == c) for c in (1, 0))
        if b >= 3 and b * n1 >= a * n0:
            harmless.add(p)
    assert set(model.exceptions) == harmless and fold("idiot savant") in harmless and bare.lexicon
    got = {r["doc_id"]: r for r in toxicity(frame, marked).collect()}
    for i, t in rows:
        total, hits, n = plain_match(fold(t), model)
        x = [1.0, math.log1p(total), total / math.sqrt(n + 25), 100 * total / (n + 50), math.log1p(n)]
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(model.weights, x, strict=True))))))
        assert got[i]["hits"] == hits and abs(got[i]["score"] - score) < 1e-9
    assert np.mean([got[i]["predicted"] == m[2] for (i, _), m in zip(rows, marks, strict=True)]) > 0.99


def test_quality_equals_plain_trees(spark):
    """The whole query on a small fixture: statistics by loops, and trees grown by trying every split of every node."""
    import math
    import random
    import zlib

    from archlens.llm import quality as q

    def plain_statistics(text):
        data = text.encode()
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        if not words:
            return [0.0] * len(STATISTICS)
        n, size = len(words), len(data)
        count = sorted((words.count(w) for w in set(words)), reverse=True)
        of = lambda chars: sum(c in chars for c in data) / size
        return [
            math.log1p(n), math.log1p(size), size / n, math.log1p(max(map(len, words))), len(set(words)) / n**0.8, count[0] / n, sum(count[:3]) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
            sum(b" " not in x.strip() for x in lines) / len(lines), of(q._UPPER), of(q._DIGIT), of(q._PUNCT), of(q._SYMBOL), of(b"|"), of(b"!"),
            of(b" \t\n\r"), sum(c >= 128 for c in data) / size, of(b"."), of(b","), sum(w[0] in q._UPPER for w in words) / n,
            sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 12 for w in words) / n, sum(w[-1] in q._SYMBOL or w[-2:] == b"!!" for w in words) / n,
        ]

    rng, rows, marks = random.Random(6), [], []
    for i in range(90):
        good = i % 2
        words = [rng.choice(["the", "house", "River,", "a", "stood."]) if good else rng.choice(["BUY", "NOW!!", "$$$", "a|b", "77"]) for _ in range(rng.randrange(6, 40))]
        rows.append((i, " ".join(words) + ("\n" if i % 3 else "") + rng.choice(["end.", "END"])))
        marks.append((i, good if i % 9 else 1 - good, 0, None))
    x = [plain_statistics(t) for _, t in rows]
    assert np.allclose(x, [statistics(t) for _, t in rows])
    learn = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    xs, ys = [x[i] for i in learn], [marks[i][1] for i in learn]
    n, f = len(xs), len(STATISTICS)
    edges = [sorted({float(e) for e in np.quantile([r[j] for r in xs], np.linspace(0, 1, q.BINS)[1:-1])}) for j in range(f)]
    share = (sum(ys) + 1) / (n + 2)
    start = math.log(share / (1 - share))
    raw, test = [start] * n, [start] * len(rows)
    for _ in range(q.TREES):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g, h = [y - a for y, a in zip(ys, p, strict=True)], [a * (1 - a) for a in p]

        def grown(inside, every, depth, g=g, h=h):
            if depth == q.DEPTH or len(inside) < 2 * q.LEAF:
                best = None
            else:
                best, top = None, 1e-6
                sg, sh = sum(g[i] for i in inside), sum(h[i] for i in inside)
                for j in range(f):
                    for e in edges[j]:
                        low = [i for i in inside if xs[i][j] <= e]
                        if len(low) < q.LEAF or len(inside) - len(low) < q.LEAF:
                            continue
                        a, b = sum(g[i] for i in low), sum(h[i] for i in low)
                        gain = a * a / (b + q.RIDGE) + (sg - a) ** 2 / (sh - b + q.RIDGE) - sg * sg / (sh + q.RIDGE)
                        if gain > top + 1e-9:
                            best, top = (j, e), gain
            if best is None:
                value = q.RATE * sum(g[i] for i in inside) / (sum(h[i] for i in inside) + q.RIDGE)
                for i in inside:
                    raw[i] += value
                for i in every:
                    test[i] += value
                return
            j, e = best
            grown([i for i in inside if xs[i][j] <= e], [i for i in every if x[i][j] <= e], depth + 1)
            grown([i for i in inside if xs[i][j] > e], [i for i in every if x[i][j] > e], depth + 1)

        if _ >= 12:
            break
        grown(list(range(n)), list(range(len(rows))), 0)
    was = q.TREES
    q.TREES = 12
    try:
        got = {r["doc_id"]: r["score"] for r in quality(docs(spark, rows), labels(spark, marks)).collect()}
    finally:
        q.TREES = was
    assert np.allclose([got[i] for i, _ in rows], [1 / (1 + math.exp(-r)) for r in test], atol=1e-6)


def test_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    marks = labels(spark, [(i, 1, 0, None) for i in range(8)])
    import tempfile

    names = ("toxic_score", "toxic_hits", "quality_score", "score", "doc", "judged", "__judged", "__id", "__kept", "key", "stays", "times", "copies", "hash", "of", "digest", "id")
    rows = docs(spark, ODD).drop("score", "size", "key", "rule").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    with tempfile.TemporaryDirectory() as d:
        marks.write.parquet(f"{d}/labels.parquet")
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, d)
            got = at.collect()
            assert at.columns == rows.columns and got and all(r[n] == f"own {n}" for r in got for n in names)
        assert corpus_pipeline.STAGES[-1][1](spark, at, d).count() > 0


def test_session_is_left_alone_and_scratch_is_cleared(spark):
    import os

    from archlens.llm.minhash_dedup import near_duplicates

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, base = spark.conf.get(key), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = near_duplicates(docs(spark, [*ODD, (30, " ".join(f"w{i}" for i in range(50))), (31, " ".join(f"w{i}" for i in range(51)))]), 4)
    (own,) = set(os.listdir(base)) - before
    assert spark.conf.get(key) == was and {x.split("-")[0] for x in os.listdir(f"{base}/{own}")} == {"signatures", "placed"}
    assert {r["component_id"] for r in got.where("doc_id >= 30").collect()} == {30}
