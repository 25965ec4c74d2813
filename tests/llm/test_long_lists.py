"""Near copies in posting lists that are too long for one task, against brute force."""

import random

from archlens.llm import minhash_dedup
from archlens.llm.minhash_dedup import near_duplicates
from tests.llm.helpers import docs
from tests.llm.test_pairs import brute


def test_near_copies_made_of_frequent_words_only(spark, monkeypatch):
    """Each text is half of the same words: all lists are long, under pairs of keys too, and copies differ in size."""
    for name, value in (("LONGEST", 4), ("WINDOW", 1)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng, words, rows = random.Random(4), [f"w{i}" for i in range(200)], []
    for i in range(300):
        picked = rng.sample(words, rng.randrange(90, 111))
        rows.append((i, " ".join(picked)))
        if i % 2:
            rows.append((1000 + i, " ".join(picked[:-12])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), 1).collect()}
    want = brute(rows, 1)
    assert got == want and sum(i >= 1000 and c < i for i, (_, c) in want.items()) == 150
