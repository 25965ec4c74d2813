"""The question log: a fold of append-only entries in batch, and what retention keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Records kept, days kept, bytes kept.
RECORDS, DAYS, BYTES = 200, 90, 2 << 20


def label_of_status(status):
    return F.when(status == "matched", "match").when(status == "no-match", "no match").otherwise("unsure")


def folded(log: DataFrame) -> DataFrame:
    """(entry_id, asked_at, verdict, seq) of log(entry_id, kind, label, seq, at): the last question of an entry, and the last
    verdict after it. A verdict without an earlier question is dropped; a later question takes the verdict back.
    """
    asked = log.where("kind = 'question'").groupBy("entry_id").agg(F.max("seq").alias("seq"), F.max_by("at", "seq").alias("asked_at"))
    told = log.where("kind = 'verdict'").select("entry_id", "label", F.col("seq").alias("vseq"))
    last = asked.join(told, "entry_id").where("vseq > seq").groupBy("entry_id").agg(F.max_by("label", "vseq").alias("verdict"))
    return asked.join(last, "entry_id", "left").select("entry_id", "asked_at", "verdict", "seq")


def retained(rows: DataFrame, group: str, at: str, size: str, seq: str, records: int = RECORDS, days: int = DAYS, bytes_: int = BYTES) -> DataFrame:
    """The newest records of each group within the bounds on number, age against the group's newest, and bytes."""
    newest = Window.partitionBy(group).orderBy(F.desc(seq))
    young = rows.withColumn("__last", F.max(at).over(Window.partitionBy(group))).where(F.col(at) >= F.expr(f"__last - interval {days} days"))
    cut = young.withColumn("__n", F.row_number().over(newest)).withColumn("__b", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cut.where((F.col("__n") <= records) & (F.col("__b") <= bytes_)).drop("__last", "__n", "__b")


def rotated(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """(group, lines, generations, bytes) of logs that begin a new generation when a line does not fit; bytes: of the last one.

    When a line fits depends on all before it, so a log's sizes are folded in order as one array of numbers.
    """
    sizes = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).cast("long").alias("generations"))
    full = lambda a, x: (a["used"] > 0) & (a["used"] + x["s"] > most)
    step = lambda a, x: F.struct(F.when(full(a, x), x["s"]).otherwise(a["used"] + x["s"]).alias("used"), (a["generations"] + full(a, x).cast("long")).alias("generations"))
    return sizes.select(group, F.size("all").cast("long").alias("lines"), F.aggregate("all", start, step).alias("r")).select(group, "lines", "r.generations", F.col("r.used").alias("bytes"))


def merged_aliases(*stores: DataFrame) -> DataFrame:
    """(alias, node, store) of stores(alias, node): each pair once, the alias in lower case with single spaces; store: the first that has it."""
    rows = [df.select(F.lower(F.trim(F.regexp_replace("alias", r"\s+", " "))).alias("alias"), "node", F.lit(i).alias("store")) for i, df in enumerate(stores)]
    return reduce(DataFrame.unionByName, rows).where("alias <> ''").groupBy("alias", "node").agg(F.min("store").alias("store"))
