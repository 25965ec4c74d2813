"""Windows of sorted passes over ranges much shorter than a window."""

import numpy as np
from pyspark.sql import functions as F

from archlens.llm import embed_dedup
from archlens.llm.common import Scratch
from tests.llm.test_pairs import united


def test_borders_of_short_ranges():
    got = embed_dedup._borders([(0, False), (2, True), (3, True), (7, False), (8, False), (9, True)])
    assert got == [(0, 0, 0), (0, 1, 1), (2, 2, 1), (3, 2, 1), (7, 0, 1), (7, 1, 2), (8, 0, 2), (8, 1, 3), (9, 2, 3)]


def test_no_neighbour_is_lost_between_ranges_of_ten_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8))
    x = (centres[rng.integers(0, 60, 300)] + 0.05 * rng.normal(size=(300, 8))).astype("<f4")
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, vector binary")
    monkeypatch.setattr(embed_dedup, "WINDOW", 40)
    passes = 3
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        links = {(r["a"], r["b"]) for r in embed_dedup.window_links(classes, "<f4", 0.95, passes, Scratch(spark)).collect()}
        sizes = [r["count"] for r in embed_dedup._keys(classes, "<f4", passes, 7).repartitionByRange("pass", "key", "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert np.median(sizes) <= 20
    order = {}
    for r in embed_dedup._keys(classes, "<f4", passes, 7).orderBy("pass", "key", "id").collect():
        order.setdefault(r["pass"], []).append(r["id"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(min(a, b), max(a, b)) for ids in order.values() for i, a in enumerate(ids) for b in ids[i + 1 : i + 41] if u[a] @ u[b] >= 0.95}
    assert links <= {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a] @ u[b] >= 0.95}
    assert united(range(300), links) == united(range(300), want) and len(want) > 200
