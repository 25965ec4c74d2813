"""Vector codes, shared lines and ranked search against plain versions, and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

from archlens.llm import line_dedup, ranked_search, vector_codes
from tests.llm.helpers import ODD, docs
from tests.llm.test_pairs import vectors


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, label, vector) of usable vectors of one length that parts divides."""
    x = {i: [math.floor(Fraction(float(c)) * scale) for c in v] for i, _, v in rows}
    w = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * w : p * w + w] for p in range(parts)] for i, v in x.items()}
    books = [[cut[i][p] for i in sorted(x)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda e: (far(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for i in cut:
                met.setdefault(near(cut[i][p], books[p]), []).append(cut[i][p])
            books[p] = [[sum(c) // len(met[e]) for c in zip(*met[e], strict=True)] if e in met else b for e, b in enumerate(books[p])]
    at = {i: [near(c, books[p]) for p, c in enumerate(cut[i])] for i in cut}
    error = {i: sum(far(cut[i][p], books[p][e]) for p, e in enumerate(at[i])) for i in cut}
    by = Counter()
    for i, label, _ in rows:
        by[label] += error[i]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (bytes(at[i]).hex(), error[i], by[label], sha) for i, label, _ in rows}


def labelled(spark, rows):
    made = [(i, label, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, label, v in rows]
    return spark.createDataFrame(made, "vec_id long, label int, embedding array<double>, code string, error int")


def codes(spark, rows, **more):
    return [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(labelled(spark, rows), **more).collect()]


def test_codes_equal_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [None, 1, 2][i % 3], rng.integers(-3, 4, 16) / 8 if i % 2 else rng.normal(size=16)) for i in rng.permutation(300)]
    want = plain_codes(rows)
    assert {r[0]: r[1:] for r in codes(spark, rows)} == want
    monkeypatch.setattr(vector_codes, "LABELS", 1)  # labels too many to broadcast
    assert {r[0]: r[1:] for r in codes(spark, rows)} == want


def test_codes_of_huge_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1, rng.normal(size=8) * 10.0 ** int(rng.integers(0, 8))) for i in range(60)]
    got, want = {r[0]: r[1:] for r in codes(spark, rows)}, plain_codes(rows)
    assert got == {i: (c, min(e, 2**63 - 1), min(s, 2**63 - 1), h) for i, (c, e, s, h) in want.items()}
    got = codes(spark, [(1, 1, [1e308] * 8), (2, 1, [-1e308] * 8), (3, 2, [0.0] * 8)], entries=1)
    assert sorted(r[2] for r in got) == [0, 2**63 - 1, 2**63 - 1]  # the one entry is the mean, 0


def test_codes_of_odd_vectors(spark):
    rows = [(5, 1, [1, 2, 3]), (1, None, None), (2, 1, [1, None, 3]), (3, 1, [1, float("nan"), 3]), (4, 1, [1, float("-inf"), 3]), (6, None, [1, 2]), (None, 1, [1, 2, 4]), (5, 1, [1, 2, 3]), (7, 2, [])]
    got = codes(spark, rows)
    assert sorted((r[:4] for r in got), key=str) == sorted([(5, "00" * 8, 0, 0), (5, "00" * 8, 0, 0), (6, None, None, None), (7, None, None, None), (None, "0000020000000000", 0, 0)], key=str)
    assert codes(spark, []) == [] and [r[1] for r in codes(spark, [(1, 1, []), (2, 1, [])])] == ["00" * 8] * 2


def test_codes_stand_for_vectors(spark):
    rng = np.random.default_rng(3)
    rows = vector_codes.usable(vectors(spark, [(i, np.float32(rng.normal(size=64))) for i in range(400)]).selectExpr("*", "1 as label"), "vec_id", "embedding", "label")
    books = vector_codes.train(rows, 64)
    coded = vector_codes.encode(rows, books, 64)
    x = {r["vec_id"]: r["x"] for r in rows.collect()}
    y = {r["vec_id"]: r["x"] for r in vector_codes.decode(coded, books, 64).collect()}
    off = np.mean([np.square(np.array(x[i]) - y[i]).sum() for i in x])
    assert set(x) == set(y) and off < 0.7 * np.mean([np.square(x[i]).sum() for i in x])


def plain_lines(rows):
    """rows: (doc_id, text)"""
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t.strip("\t\n\x0b\x0c\r "))
    rank = lambda d: (d is not None, d or 0)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(fold(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := fold(x)) >= 20 and len(held[k]) >= 3 and max(held[k], key=rank) != d for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def dropped(spark, rows):
    return sorted((tuple(r) for r in line_dedup.line_dedup(docs(spark, rows)).collect()), key=str)


def test_shared_lines_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"a passage number {i} that documents share" for i in range(30)] + ["short", "", "   ", "é" * 20, "é" * 19, "x" * 19 + " "]
    rows = []
    for i in range(400):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [f"only here {i} and nowhere else"]
        lines = [rng.choice([x, x.upper() if "é" not in x else x, f"\t{x}  ", x + "\r", x + " "]) for x in lines]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[3][1]), (3, "another text\na passage number 1 that documents share"), (None, rows[7][1]), (None, pool[2])]
    want = plain_lines(rows)
    assert dropped(spark, rows) == want and sum(r[2] for r in want) > 500
    monkeypatch.setattr(line_dedup, "RUN", 1)  # nothing merges before the shuffle
    assert dropped(spark, rows) == want


def test_two_documents_keep_a_line_and_three_do_not(spark):
    line = "exactly twenty chars"
    assert len(line) == 20
    assert dropped(spark, [(1, line), (2, line)]) == [(1, 1, 0, line), (2, 1, 0, line)]
    assert dropped(spark, [(1, line), (2, line), (9, f"{line}\n{line}")]) == [(1, 1, 1, ""), (2, 1, 1, ""), (9, 2, 0, f"{line}\n{line}")]


def test_shared_lines_of_odd_rows(spark):
    rows = [r[:2] for r in ODD] + [(20, "\n".join(["a line that is long enough"] * 50_000)), (21, "a line that is long enough"), (22, "A LINE that is long enough\n")]
    assert dropped(spark, rows) == plain_lines(rows)
    assert dropped(spark, []) == []


def test_bitmaps_are_small_and_keep_what_lies_beyond(spark):
    rows = [(i, "\n".join(["a line that many documents have"] + [f"{i} own line {j}" for j in range(5000)])) for i in range(4)]
    got = line_dedup.keep_bitmaps(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(0, 1), (1, 1), (2, 1)] and max(len(r["keep"]) for r in got) < 20
    assert line_dedup.kept_lines(rows[0][1], got[0]["keep"]).count("\n") == 4999


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=10):
    """rows: (doc_id, text), items: (item_id, text)"""
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(x), len(x)) for d, t in rows if (x := terms(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, c in asked.items():
        scores = []
        for d, tf, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, times in c.items() if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, items, **more):
    asked = spark.createDataFrame([(*r, 1.0, 7) for r in items], "item_id long, text string, score double, rank int")
    return sorted((tuple(r) for r in ranked_search.ranked_search(docs(spark, rows), asked, **more).collect()), key=str)


def test_search_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "the", "THE", "x1", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", "\x7f"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 30))) for i in range(500)] + [(3, "the the w1"), (None, "w1 w2"), (None, "w1 w2"), (900, None)]
    items = [(i, text(rng.randint(0, 9))) for i in range(40)] + [(2, "w7 w7 w8"), (None, "w1"), (None, "w2"), (99, "nothing"), (98, None)]
    want = plain_search(rows, items)
    assert searched(spark, rows, items) == want and len(want) > 300
    assert searched(spark, rows, items, item_terms=20, vocabulary=3) == want  # many blocks, all terms kept
    monkeypatch.setattr(ranked_search, "DOCS", 7)
    assert searched(spark, rows, items) == want


def test_search_of_odd_rows(spark):
    rows = [r[:2] for r in ODD]
    items = [(1, "one word3"), (2, "ÜNÏ ünï cödé"), (3, ""), (4, "nobody s text")]
    assert searched(spark, rows, items) == plain_search(rows, items)
    assert searched(spark, [], items) == [] and searched(spark, rows, []) == [] and searched(spark, [(1, "!"), (2, None)], items) == []


def test_impacts_beyond_64_bits():
    got = ranked_search._impacts(np.array([2, 10**10]), np.array([10**9, 10**12]), 10**12, 10**14)
    assert got.tolist() == [(10**9 * tf) // (1000 * tf + 8 * (25 + 75 * n * 10**12 // 10**14)) for tf, n in ((2, 10**9), (10**10, 10**12))]
