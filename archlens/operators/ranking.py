"""Concept search, lexical ranking and the decision to accept, ask or abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.functions.text import concept_terms, normalize_question

# Field weights, BM25 parameters and floors, temperature.
FIELDS = {"name": 2.0, "path": 0.5, "docstring": 1.5}
K1, B, FLOOR, COVERAGE, HITS = 1.2, 0.75, 4.0, 0.5, 8
TEMPERATURE = 1.5


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf): each field adds its weight for each of its terms; docs(id, name, path, docstring)."""
    weighed = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))
    fields = F.flatten(F.array(*[F.transform(concept_terms(F.col(f)), weighed(w)) for f, w in FIELDS.items()]))
    return docs.select("id", F.explode(fields).alias("x")).groupBy("id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def lengths(post: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, length) of all documents."""
    return docs.select("id").join(post.groupBy("id").agg(F.sum("tf").alias("length")), "id", "left").select("id", F.coalesce("length", F.lit(0.0)).alias("length"))


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, n): distinct terms of each question and their number."""
    t = F.array_distinct(concept_terms(normalize_question(F.col("question"))))
    return questions.select("qid", t.alias("t")).select("qid", F.explode("t").alias("term"), F.size("t").alias("n"))


def bm25(docs: DataFrame, questions: DataFrame, hits: int = HITS) -> DataFrame:
    """(qid, rank, id, score, matched): candidates of questions(qid, question) in docs(id, name, path, docstring[, kind])."""
    from archlens.operators import text_index

    return text_index.search(text_index.build(docs), questions, hits)


def edit_distance(a: Column, b: Column, cap: int = 2) -> Column:
    """Edit distance, cap + 1 where it is more; lengths that differ by more are not compared."""
    d = F.levenshtein(a, b, cap)
    return F.when(F.abs(F.length(a) - F.length(b)) > cap, cap + 1).otherwise(F.when(d == -1, cap + 1).otherwise(d))


def _less_one(c: Column) -> Column:
    """What is left of a string when one letter goes, for each letter."""
    whole = F.length(c)
    left = F.transform(F.sequence(F.lit(1), whole), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, whole)))
    return F.when(whole > 0, left).otherwise(F.array().cast("array<string>"))


#: Words up to this length are found by what is left when two letters go, longer ones by their pieces.
DELETED = 9


def close_words(words: DataFrame) -> DataFrame:
    """(name, other, d) of words(name), distinct: pairs name < other that are one or two edits apart.

    Words meet by equal joins on what both hold: short ones on a string that both become when two letters at most go, longer ones on
    one of three pieces, moved by two at most. No word meets all words of its length.
    """
    c, three = F.col("name"), F.sequence(F.lit(0), F.lit(2))
    whole, none = F.length("name"), F.array().cast("array<string>")
    once = _less_one(c)
    short = F.transform(F.array_distinct(F.concat(F.array(c), once, F.flatten(F.transform(once, _less_one)))), lambda x: F.concat(F.lit("-"), x))
    size = lambda n, i: F.when(i < 2, F.floor(n / 3)).otherwise(n - 2 * F.floor(n / 3)).cast("int")
    start = lambda n, i: (1 + i * F.floor(n / 3)).cast("int")
    key = lambda n, i, p: F.concat_ws("|", n.cast("string"), i.cast("string"), F.substring(c, p, size(n, i)))
    fits = lambda n, i: F.filter(F.sequence(start(n, i) - 2, start(n, i) + 2), lambda p: (p >= 1) & (p + size(n, i) - 1 <= whole))
    tried = F.flatten(F.transform(F.sequence(F.greatest(F.lit(DELETED + 1), whole - 2), F.greatest(F.lit(DELETED + 1), whole + 2)), lambda n: F.flatten(F.transform(three, lambda i: F.transform(fits(n, i), lambda p: key(n, i, p))))))
    asked = F.concat(F.when(whole <= DELETED + 2, short).otherwise(none), F.when(whole >= DELETED - 1, tried).otherwise(none))
    own = F.when(whole <= DELETED, short).otherwise(F.transform(three, lambda i: key(whole, i, start(whole, i))))
    a = words.select("name", F.explode(F.array_distinct(asked)).alias("key"))
    b = words.select(c.alias("other"), F.explode(own).alias("key"))
    met = a.join(b, "key").where(F.col("name") != F.col("other")).select(F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")).distinct()
    return met.withColumn("d", edit_distance(F.col("name"), F.col("other"))).where("d <= 2")


def head(scores: DataFrame) -> DataFrame:
    """scores(qid, idx, id, score) with rank, probability (softmax) and margin to the runner-up, 0 if there is none."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    every = Window.partitionBy("qid")
    p = F.exp((F.col("score") - F.max("score").over(every)) / TEMPERATURE)
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("e", p).withColumn("p", F.col("e") / F.sum("e").over(every)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))).drop("e")
