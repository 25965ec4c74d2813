"""Folders as intervals and exact quantiles against plain versions."""

import math
import random

from archlens.operators import folders, quantiles


def paths(rng, n):
    names = ["a", "b", "a-b", "a.b", "zz", "B"]
    return sorted({"/".join([*rng.choices(names, k=rng.randrange(0, 5)), f"f{i}"]) for i in range(n)})


def test_points_meet_intervals(spark):
    rng = random.Random(1)
    spans = [(i, *sorted((rng.randrange(0, 300), rng.randrange(0, 300)))) for i in range(60)] + [(90, 0, 0), (91, 0, 2**33), (92, 7, 7)]
    points = [*range(0, 300, 7), 2**33, 2**33 + 1]
    got = folders.within(spark.createDataFrame([(p,) for p in points], "rank long"), spark.createDataFrame(spans, "id int, lo long, hi long"))
    assert sorted((r["rank"], r["id"]) for r in got.collect()) == sorted((p, i) for p in points for i, lo, hi in spans if lo <= p <= hi)


def test_listing_is_level_by_level(spark):
    files = paths(random.Random(2), 120)
    every = sorted({"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)})
    ids = {r["label"]: r["id"] for r in spark.createDataFrame([(x,) for x in every], "label string").select("label", folders.folder_id("label").alias("id")).collect()}
    asked = list(enumerate([*every[::5], "nowhere"]))
    got = {}
    for r in folders.listing(spark.createDataFrame([(p,) for p in files], "path string"), spark.createDataFrame(asked, "qid int, label string")).orderBy("qid", "n").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for qid, label in asked:
        queue = [label]
        for at in queue:
            queue += sorted((x for x in every if x.rpartition("/")[0] == at and x != at and "/" in x), key=ids.get)
        want = [ids[x] for x in queue[1:]] + [p for p in files if p.startswith(label + "/")]
        assert got.get(qid, []) == want, label


def test_edges_of_what_a_session_sees(spark):
    rng = random.Random(3)
    files = paths(rng, 80)
    every = sorted({"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)})
    edges = [(rng.choice(files), rng.choice(files), rng.choice(["import", "rpc", "realtime"])) for _ in range(400)]
    opened = [(s, x) for s in range(6) for x in rng.sample(every, s * 3)] + [(9, "nowhere")]
    got = folders.collapsed(spark.createDataFrame([(p,) for p in files], "path string"), spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame(opened, "session int, label string"))
    want = {}
    for s in {s for s, _ in opened}:
        mine = {x for t, x in opened if t == s}

        def seen(p, mine=mine):
            return next((f for i in range(1, p.count("/") + 1) if (f := "/".join(p.split("/")[:i])) not in mine), p)

        for a, b, t in set(edges):
            if t != "realtime" and seen(a) != seen(b):
                want[s, seen(a), seen(b), t] = want.get((s, seen(a), seen(b), t), 0) + 1
    assert {tuple(r)[:4]: r["weight"] for r in got.collect()} == want


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [("even", float(i)) for i in range(1000)] + [("one", 3.5)] + [("same", 7.0)] * 500 + [("mixed", rng.choice([0.0, 5e-324, -5e-324, 1e-300, 1e308, -1e308, rng.gauss(0, 1)])) for _ in range(300)]
    rows += [(None, x) for x in (2.0, 1.0)] + [("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", 4.0), ("none", None)]
    qs = (0.0, 0.5, 0.95, 0.99, 1.0)
    for buckets in (3, 1024):
        got = {(r["g"], r["q"]): (r["n"], r["v"]) for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", qs, buckets).collect()}
        for g in ("even", "one", "same", "mixed", None, "odd"):
            values = sorted(v for h, v in rows if h == g and v is not None and math.isfinite(v))
            assert {q: got[g, q] for q in qs} == {q: (len(values), values[max(1, math.ceil(round(q * len(values), 9))) - 1]) for q in qs}
        assert ("none", 0.5) not in got
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", (0.5,)).count() == 0
