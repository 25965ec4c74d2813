"""Orders of classes are made of numbers: what is closed over bases holds no ids."""

from archlens.operators import graph
from archlens.sources import extract

FILES = [("a/x.py", "class A:\n    pass\n\nclass B(A):\n    pass\n"), ("a/y.py", "from a.x import A, B\nimport gone\n\nclass C(B, A):\n    pass\n\nclass D(gone.E):\n    pass\n\nclass F(C):\n    pass\n\nclass G(A, B):\n    pass\n")]


def test_bases_are_closed_over_by_number(spark, monkeypatch):
    kinds, real = [], extract.closure
    monkeypatch.setattr(extract, "closure", lambda pairs: kinds.append(dict(pairs.dtypes)) or real(pairs))
    found = {}
    for r in extract.linearizations(extract.python_facts(spark.createDataFrame(FILES, "path string, text string"))).collect():
        found.setdefault(r["class"], {})[r["position"]] = r["ancestor"]
    order = {c: [x for _, x in sorted(o.items())] for c, o in found.items()}
    assert order == {
        "a/x.py#A": ["a/x.py#A"], "a/x.py#B": ["a/x.py#B", "a/x.py#A"], "a/y.py#C": ["a/y.py#C", "a/x.py#B", "a/x.py#A"],
        "a/y.py#F": ["a/y.py#F", "a/y.py#C", "a/x.py#B", "a/x.py#A"],
    }
    assert kinds == [{"src": "bigint", "dst": "bigint"}]


def test_a_closure_writes_each_pair_once(spark, monkeypatch):
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(real(df)) or written[-1])
    pairs = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    assert graph.closure(pairs).count() == 36 and sum(df.count() for df in written) == 36
