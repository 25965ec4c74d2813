"""Small tables with the cases that every operator must stand."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("rule", T.StringType())])


def docs(spark, rows):
    """rows: (doc_id, text[, source]); the further columns clash with names that operators use."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 0.5, "x", "k", None) for r in rows], DOCS)


WORDS = [f"word{i}" for i in range(400)]
ODD = [(1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "one", "b"), (5, "one", "b"), (6, " ".join(WORDS * 200), "b"), (None, "nobody's text", "a"), (7, "ünï\u00a0cödé \x85 text", None), (4, "one", "b"), (8, " " * 1_000_000, "b"), (9, "x" * 300_000, "a"), (11, "\n" * 300_000, None)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
