"""Near copies of many texts: tables that grow with the texts are not sent through the driver."""

from archlens.llm import common, minhash_dedup
from archlens.llm.minhash_dedup import near_duplicates
from tests.llm.helpers import docs
from tests.llm.test_pairs import brute


def test_tables_of_many_texts_are_joined_by_sorting(spark, monkeypatch):
    for module in (common, minhash_dedup):
        monkeypatch.setattr(module, "WIDE_ROWS", 10, raising=False)
    plans, put = [], common.Scratch.put

    def told(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return put(self, df, name)

    monkeypatch.setattr(common.Scratch, "put", told)
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, text(i % 60, 40 + i // 60)) for i in range(150)]
    found = near_duplicates(docs(spark, rows), 2)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(rows, 2)
    assert {name for name, _ in plans} >= {"postings", "members", "links", "linked", "placed"}
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan and name not in ("cc", "side")]
