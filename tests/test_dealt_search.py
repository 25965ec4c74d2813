"""Many questions are searched in tasks that hold blocks of postings, with the hits of the join."""

import random

import pytest

from archlens.operators import dealt_search, text_index


def rows(rng, n):
    words = [f"term{i}" for i in range(40)] + ["storage", "zebra"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.12)), 41)] for _ in range(k))
    # Some ids come twice, some texts are the same, so that scores are equal.
    return [(i - i % 7 // 6, rng.choice(["file", "layer", "symbol", "other", None]), f"src{i % 3}", pick(1), pick(rng.randrange(0, 9)) if i % 9 else None) for i in range(n)]


@pytest.fixture
def short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "40")  # the postings of a term are cut into many chunks
    yield
    spark.conf.set(key, was)


@pytest.mark.parametrize("posts", [16_000_000, 300])
def test_same_hits_as_the_join(spark, monkeypatch, short_batches, posts):
    rng = random.Random(5)
    docs = spark.createDataFrame(rows(rng, 500), "id long, kind string, name string, path string, docstring string")
    term = lambda: f"term{min(int(rng.expovariate(0.1)), 39)}"
    asked = [(i, " ".join(term() for _ in range(rng.randrange(1, 6))) + rng.choice(["", " src0", " src1 file", " folder", " function"])) for i in range(300)]
    asked += [(900, "term1 unheard"), (901, ""), (902, "zebra"), (903, asked[0][1]), (904, asked[0][1])]
    questions = spark.createDataFrame(asked, "qid int, question string")
    index = text_index.build(docs)
    told = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 5), r["matched"]) for r in df.collect())
    want = told(text_index.search(index, questions))
    assert len(want) > 1000
    monkeypatch.setattr(text_index, "PAIRS", 0)
    monkeypatch.setattr(dealt_search, "POSTS", posts)
    found = text_index.search(index, questions)
    assert found.columns == ["qid", "rank", "id", "score", "matched"]
    assert told(found) == want
    assert told(text_index.search(index, questions, 3)) == [r for r in want if r[1] <= 3]


def test_no_pair_of_question_and_document_leaves_a_task(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PAIRS", 0)
    docs = spark.createDataFrame([(i, f"n{i}", "", "storage common" if i % 4 else "storage") for i in range(400)], "id long, name string, path string, docstring string")
    questions = spark.createDataFrame([(i, f"n{i} common") for i in range(400)], "qid int, question string")
    found = text_index.search(text_index.build(docs), questions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posts" not in plan
