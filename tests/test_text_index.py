"""The index of texts against a comparison of every question with every document."""

import math
import random

from archlens.operators import ranking, text_index


def rows_of(rng, n):
    words = [f"term{i}" for i in range(40)] + ["storage", "zebra"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.12)), 41)] for _ in range(k))
    return [(i, rng.choice(["file", "layer", "symbol", None]), pick(2), pick(1), pick(rng.randrange(0, 12)) if i % 9 else None) for i in range(n)]


def test_hits_equal_a_plain_search(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame(rows_of(rng, 400), "id long, kind string, name string, path string, docstring string")
    asked = [(i, " ".join(f"term{min(int(rng.expovariate(0.1)), 39)}" for _ in range(rng.randrange(1, 5))) + rng.choice(["", " file", " folder", " function"])) for i in range(60)] + [(70, "term1 unheard"), (71, ""), (72, "zebra")]
    questions = spark.createDataFrame(asked, "qid int, question string")
    held = {r["id"]: (r["kind"], r["length"], {t["term"]: t["tf"] for t in r["terms"]}) for r in text_index.documents(docs).collect()}
    mean = sum(x[1] for x in held.values()) / len(held)
    df = {}
    for _, _, terms in held.values():
        for t in terms:
            df[t] = df.get(t, 0) + 1
    terms_of = {}
    for r in ranking.query_terms(questions).collect():
        terms_of.setdefault(r["qid"], []).append(r["term"])
    hint = {q: {"file": "file", "folder": "layer", "function": "symbol"}.get(text.rpartition(" ")[2]) for q, text in asked}
    want = []
    for q, terms in terms_of.items():
        if any(t not in df for t in terms):
            continue
        found = []
        for i, (kind, length, own) in held.items():
            hit = [t for t in terms if t in own]
            score = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in hit)
            if round(score, 9) >= 4 and len(hit) / len(terms) >= 0.5:
                found.append((-round(score, 9), not (kind is not None and kind == hint[q]), i, len(hit)))
        want += [(q, n, i, m) for n, (s, _, i, m) in enumerate(sorted(found)[:8], 1)]
    got = lambda index: sorted((r["qid"], r["rank"], r["id"], r["matched"]) for r in text_index.search(index, questions).collect())
    assert got(text_index.build(docs, str(tmp_path / "index"))) == sorted(want) and len(want) > 100
    assert got(text_index.opened(spark, str(tmp_path / "index"))) == sorted(want)
    monkeypatch.setattr(text_index, "BLOCK", 7)  # many blocks of a term, spread over buckets
    assert got(text_index.build(docs)) == sorted(want)


def test_few_documents(spark):
    empty = spark.createDataFrame([], "id long, name string, path string, docstring string")
    questions = spark.createDataFrame([(1, "zebra")], "qid int, question string")
    assert text_index.search(text_index.build(empty), questions).count() == 0
    assert text_index.search(text_index.build(spark.createDataFrame([(1, None, None, None)], empty.schema)), questions).count() == 0
