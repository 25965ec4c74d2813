"""Near duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest

from archlens.llm import embed_dedup, minhash_dedup
from archlens.llm.components import components
from archlens.llm.common import Scratch
from archlens.llm.embed_dedup import near_duplicate_vectors
from archlens.llm.minhash_dedup import near_duplicates
from tests.llm.helpers import ODD, docs


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def united(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in united(ids, pairs).items()}


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(999)}"
            rows.append((at, " ".join(text)))
            at += 1
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_texts_equal_brute_force(spark, k):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), k).collect()}
    assert got == brute(rows, k)


def test_long_lists_are_posted_again(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LONGEST", 8)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "WINDOW", 16)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)] + [(100 + i, " ".join(f"y{i}_{j}" for j in range(30)) + " " + " ".join(base[:20])) for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute(rows, 4)


def test_huge_groups_are_stars_first(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("HUGE", 2), ("PIVOTS", 2)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rows = corpus(20, seed=8)
    base = [f"w{i}" for i in range(80)]
    for i in range(60):
        text = list(base)
        for j in range(random.Random(i).randrange(1, 5)):
            text[(7 * i + 13 * j) % 80] = f"x{i}_{j}"
        rows.append((1000 + i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute(rows, 4)


def test_odd_texts(spark):
    got = near_duplicates(docs(spark, ODD), 4).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] * 2 and by[5] == [(1, 4, False)] and by[None] == [(1, None, True)]
    assert by[6][0][0] == 400
    assert by[7][0][0] == 1  # white space outside ASCII does not part words
    assert near_duplicates(docs(spark, []), 4).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (501, 500), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in rows], "vec_id long, embedding array<float>, id int, component string")


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 2, 3, 40]))):
            rows.append((len(rows), np.float32(base + rng.standard_normal(32) * rng.choice([0, 0.1, 0.2]))))
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = united(range(len(rows)), np.argwhere(near).tolist())
    got = {r["vec_id"]: r for r in near_duplicate_vectors(vectors(spark, rows)).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) > 0.99


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [1, float("nan")]), (6, [1, 2]), (7, [1, 2]), (8, [2, 4]), (9, [1, 2, 0]), (None, [1, 2]), (6, [1, 2]), (10, [-0.0, 1]), (11, [0.0, 1])]
    got = {}
    for r in near_duplicate_vectors(vectors(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 9)) and got[None] == [(0, None, True)]
    assert got[6] == [(3, 6, True)] * 2 and got[7] == [(3, 6, False)] and got[8] == [(3, 6, False)]
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)]
    assert near_duplicate_vectors(vectors(spark, [])).count() == 0


BIG = 2**63 - 300


def test_components_of_any_numbers(spark, monkeypatch):
    from archlens.llm import components as module

    edges = [(BIG + i, BIG + i + 1) for i in range(90)] + [(-(2**63), -5), (-5, 2**62), *[(BIG + 200, BIG + 201 + i) for i in range(40)]]
    want = {**{BIG + i: BIG for i in range(91)}, -(2**63): -(2**63), -5: -(2**63), 2**62: -(2**63), **{BIG + 200 + i: BIG + 200 for i in range(41)}}
    for few in (module.BROADCAST, 0):
        monkeypatch.setattr(module, "BROADCAST", few)
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
        assert got == want


def test_large_and_negative_ids(spark):
    rows = [(BIG - 7 * i if i % 2 else -(2**63) + 5 * i, t) for i, t in corpus(20, seed=5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute(rows, 4)
    x = [(BIG + i, [1, i / 100]) for i in range(5)] + [(-(2**63) + i, [-1, i / 100]) for i in range(5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(vectors(spark, x)).collect()}
    assert got == {**{BIG + i: (4, BIG) for i in range(5)}, **{-(2**63) + i: (4, -(2**63)) for i in range(5)}}


def test_repeated_and_missing_ids_with_other_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " end"), (None, a), (None, "only here and nowhere else"), (3, a), (3, a)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, rows), 4).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (3, 1, False), (3, 1, False)], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in minhash_dedup.deduplicated(docs(spark, rows), 4).collect()), key=repr)
    assert left == sorted([(1, a), (1, b), (None, "only here and nowhere else")], key=repr)
    same = [(7, a), (7, a), (None, b), (None, b), (8, None), (8, "")]
    assert sorted((r["doc_id"] or 0 for r in minhash_dedup.deduplicated(docs(spark, same), 4).collect())) == [0, 7, 8, 8]


def test_passes_grow_with_the_table():
    passes = [embed_dedup.passes_for(10**e, 0.95) for e in (2, 4, 6, 8, 10)]
    assert passes == sorted(passes) and passes[0] == embed_dedup.FEWEST and passes[-1] > 2 * passes[1]


@pytest.mark.parametrize("spread", [None, 0.42])
def test_recall_of_planted_links(spark, spread):
    """Isolated pairs of a cosine a little above the threshold; in the second case a third of all vectors lie in one dense cluster whose
    members, of a mutual cosine of about 0.85, are not linked themselves."""
    rng = np.random.default_rng(9)
    d, n = 64, 6000
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    x = unit(rng.standard_normal((n, d)))
    if spread:
        x[: n // 3] = unit(unit(rng.standard_normal((1, d))) + spread * unit(rng.standard_normal((n // 3, d))))
    other = rng.standard_normal((n, d))
    other = unit(other - (other * x).sum(axis=1)[:, None] * x)
    y = 0.955 * x + np.sqrt(1 - 0.955**2) * other
    both = np.float32(np.concatenate([x, y[: n // 2]]))
    m = unit(both.astype(np.float64))
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    got = near_duplicate_vectors(vectors(spark, list(enumerate(both)))).agg({"n_links": "sum"}).first()[0]
    assert near.sum() >= n and 0.9 * near.sum() <= got <= near.sum()
