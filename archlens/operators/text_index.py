"""An index for ranked text that outlives a query: postings in blocks, bucketed by term, with the greatest contribution of each block.

A posting holds what a term adds to a document's score but for the term's weight, so the index needs no number that a later document
changes but the mean length. Blocks hold postings of a term with nearly the same contribution, and no more than about BLOCK of them, so a
term that every document has is many rows in SPREAD buckets. A question first finds its bounds: what its terms could add at most, and
a score that its eighth hit reaches for sure. A block is read only if its best posting and the best of all other terms reach that. Where
that would still be too many pairs of questions and documents, `dealt_search` finds the same in tasks that hold the postings.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.functions.text import concept_terms, kind_hint
from archlens.operators import dealt_search
from archlens.operators.graph import cut, shared_folder
from archlens.operators.ranking import B, COVERAGE, FIELDS, FLOOR, HITS, K1, query_terms

#: Postings of a block, about; steps of contribution that part blocks; buckets that the blocks of a term are spread over.
BLOCK, STEPS, SPREAD = 4096, 16, 16
#: Pairs of a question and a posting of its terms up to which blocks are joined with questions; of more, postings are dealt to tasks.
PAIRS = 20_000_000
#: What rounding may take from a bound.
SLACK = 1e-6


@dataclass
class TextIndex:
    """blocks(term, spread, best, posts array<struct<id, kind, part>>), terms(term, df, best, sure) and the number of documents."""

    blocks: DataFrame
    terms: DataFrame
    docs: int


def documents(docs: DataFrame) -> DataFrame:
    """(id, kind, length, terms array<struct<term, tf>>) of docs(id, name, path, docstring[, kind]): each field adds its weight for each of its
    terms. A document is worked out in its own row."""
    kind = F.col("kind") if "kind" in docs.columns else F.lit(None).cast("string")
    fields = docs.select("id", kind.alias("kind"), *[concept_terms(F.col(f)).alias(f) for f in FIELDS])
    fields = fields.withColumn("every", F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in FIELDS])))
    weigh = lambda t: sum((F.size(F.filter(F.coalesce(f, F.array().cast("array<string>")), lambda x: x == t)) * w for f, w in FIELDS.items()), F.lit(0.0))
    rows = fields.select("id", "kind", F.transform("every", lambda t: F.struct(t.alias("term"), weigh(t).alias("tf"))).alias("terms"))
    return rows.select("id", "kind", F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["tf"]).alias("length"), "terms")


def build(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> TextIndex:
    """The index of docs(id, name, path, docstring[, kind]); with a path it is written there and `opened` finds it again.

    Null fields hold no terms; a document without terms counts among the documents and lengths only. Of rows that repeat an id each counts as
    a document, and a hit adds them up. An empty table gives an index that finds nothing.
    """
    spark = docs.sparkSession
    rows = cut(documents(docs))
    whole = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole["n"], whole["mean"] or 1.0
    copies = rows.groupBy("id", "kind").count().agg(F.max("count")).first()[0] or 1  # a hit adds up the rows of its id, so bounds must
    part = F.col("t.tf") * (K1 + 1) / (F.col("t.tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    posts = rows.select("id", "kind", "length", F.explode("terms").alias("t")).select("id", "kind", F.col("t.term").alias("term"), part.alias("part"))
    step = F.floor(F.col("part") * STEPS).cast("int")
    salt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(max(1, -(-n // BLOCK)))).cast("int")
    blocks = posts.groupBy("term", step.alias("step"), salt.alias("salt")).agg(F.count("*").alias("n"), (F.max("part") * copies).alias("best"), F.collect_list(F.struct("id", "kind", "part")).alias("posts"))
    blocks = blocks.withColumn("spread", F.pmod(F.col("salt"), F.lit(SPREAD)))
    where = path or f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"text_index_{uuid.uuid4().hex}"
    blocks.repartition(buckets, "term", "spread").write.bucketBy(buckets, "term", "spread").sortBy("term", "spread").option("path", f"{where}/blocks").saveAsTable(name)
    made = spark.table(name)
    # The eighth best posting of a term is no worse than the lower end of the step in which the eighth from above lies.
    steps = made.groupBy("term", "step").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("step").desc()))  # some dozens of rows a term
    terms = steps.withColumn("above", above).groupBy("term").agg(
        F.sum("n").alias("df"), F.max("best").alias("best"), F.coalesce(F.max(F.when(F.col("above") >= HITS * copies, F.col("step"))) / STEPS, F.lit(0.0)).alias("sure")
    )
    terms.write.parquet(f"{where}/terms")
    spark.createDataFrame([(n, buckets)], "docs long, buckets int").write.parquet(f"{where}/about")
    return TextIndex(made, spark.read.parquet(f"{where}/terms"), n)


def opened(spark: SparkSession, path: str) -> TextIndex:
    """An index that was written to path."""
    about, name = spark.read.parquet(f"{path}/about").first(), f"text_index_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/blocks").schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (term, spread) sorted by (term, spread) into {about['buckets']} buckets location '{path}/blocks'")
    return TextIndex(spark.table(name), spark.read.parquet(f"{path}/terms"), about["docs"])


def search(index: TextIndex, questions: DataFrame, hits: int = HITS) -> DataFrame:
    """(qid, rank, id, score, matched): the best documents of questions(qid, question), FLOOR at least and with half of its terms.

    A question with a term that no document has finds nothing. Equal scores go by the kind that the question hints at, then by id.
    """
    asked = query_terms(questions).join(index.terms, "term", "left")
    idf = F.log(1 + (F.lit(index.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.withColumn("idf", idf)
    every = Window.partitionBy("qid")
    asked = asked.withColumn("known", F.count("df").over(every)).withColumn("most", F.sum(F.col("idf") * F.col("best")).over(every))
    # One term is half of two: then its own eighth hit is a hit of the question. Of longer questions only the floor is sure.
    sure = F.when((F.col("n") * COVERAGE <= 1) & F.lit(hits == HITS), F.max(F.col("idf") * F.col("sure")).over(every)).otherwise(0.0)
    asked = cut(asked.withColumn("need", F.greatest(F.lit(FLOOR), sure) - SLACK).where("known = n and most >= need"))
    if (asked.agg(F.sum("df")).first()[0] or 0) > PAIRS:
        return dealt_search.search(index, asked, questions, hits)
    spread = F.explode(F.sequence(F.lit(0), F.lit(min(SPREAD, max(1, -(-index.docs // BLOCK))) - 1)))
    tried = asked.select("qid", "n", "need", "term", "idf", (F.col("most") - F.col("idf") * F.col("best")).alias("others"), spread.alias("spread"))
    blocks = index.blocks.select("term", "spread", F.col("best").alias("top"), "posts")
    met = tried.join(blocks, ["term", "spread"]).where(F.col("idf") * F.col("top") + F.col("others") >= F.col("need"))
    rows = met.select("qid", "n", "need", "idf", F.explode("posts").alias("p"))
    scored = rows.groupBy("qid", "n", "need", F.col("p.id").alias("id"), F.col("p.kind").alias("kind")).agg(F.sum(F.col("idf") * F.col("p.part")).alias("score"), F.count("*").alias("matched"))
    kept = scored.where((F.round("score", 9) >= F.greatest("need", F.lit(FLOOR))) & (F.col("matched") / F.col("n") >= COVERAGE))
    kept = kept.join(questions.select("qid", kind_hint(F.col("question")).alias("hint")), "qid")
    likes = F.coalesce(F.col("kind") == F.col("hint"), F.lit(False))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), likes.desc(), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hits).select("qid", "rank", "id", F.round("score", 6).alias("score"), "matched")
