"""Exact order statistics of groups of any size: counts by bucket, then only the bucket that holds a rank is read again.

A round counts the values of each group in at most BUCKETS buckets of equal width between the least and the greatest value that may still
be the answer, and keeps each bucket's own least and greatest; counts merge before they are shuffled. The rank falls into one bucket, and
the next round counts that one alone. A bucket of one value, however often, is the answer. No task sees the values of a group,
so a group of a third of all rows is no hot task; what is known of the ranks is a row for each group and quantile.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.operators.graph import cut

BUCKETS = 1024
#: Ranks that are broadcast to the rows, by count; more are joined with the rows of a group dealt over SALTS keys.
RANKS, SALTS = 200_000, 64


def exact_quantiles(rows: DataFrame, group: str, value: str, quantiles: tuple[float, ...], buckets: int = BUCKETS) -> DataFrame:
    """(group, n, q, value) for each group of rows and each quantile: the value of rank ceil(q * n), the least for q = 0.

    Values are finite numbers as doubles; null and non-finite ones take no part, and a group without others has no row. A null group is a
    group of its own. Ties and repeated rows count each. An empty table gives an empty result.
    """
    fine = F.col(value).cast("double")
    rows = rows.select(F.col(group).alias("g"), fine.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))
    ends = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    every = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(Decimal(str(q))).cast("decimal(10,9)").alias("exact")) for q in quantiles])).alias("e")
    asked = ends.select("g", "n", "lo", "hi", every).select("g", "n", "e.q", F.greatest(F.lit(1), F.ceil(F.col("n").cast("decimal(20,0)") * F.col("e.exact")).cast("long")).alias("rank"), "lo", "hi")
    open_, done = asked, []
    while True:
        open_ = cut(open_)
        done.append(open_.where("lo = hi").select("g", "n", "q", F.col("lo").alias("x")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        open_ = _refined(rows, open_, buckets)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("g").alias(group), "n", "q", F.col("x").alias(value))


def _refined(rows: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """asked(g, n, q, rank, lo, hi) with the bounds of the bucket that holds the rank, and the rank within it."""
    spans = cut(asked.select(F.col("g").alias("of"), "lo", "hi").distinct())
    same = F.col("g").eqNullSafe(F.col("of")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    if spans.count() <= RANKS:
        met = rows.join(F.broadcast(spans), same)
    else:
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
        met = dealt.join(spans.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("salt") == F.col("to")))
    # Halves keep the width finite for values of any size. The two ends always part, so that every round narrows the bounds.
    width = F.col("hi") / 2 - F.col("lo") / 2
    inner = F.when(width > 0, F.floor((F.col("x") / 2 - F.col("lo") / 2) / width * buckets).cast("int")).otherwise(0)
    place = F.when(F.col("x") >= F.col("hi"), buckets - 1).when(F.col("x") <= F.col("lo"), 0).otherwise(F.least(F.lit(buckets - 2), inner))
    counts = met.groupBy("of", "lo", "hi", place.alias("b")).agg(F.count("*").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    upto = F.sum("c").over(Window.partitionBy("of", "lo", "hi").orderBy("b"))  # BUCKETS rows at most
    counts = counts.withColumn("upto", upto)
    keyed = asked.alias("a").join(counts.alias("k"), F.expr("a.g <=> k.of and a.lo = k.lo and a.hi = k.hi and a.rank <= k.upto and a.rank > k.upto - k.c"))
    return keyed.select("a.g", "a.n", "a.q", F.expr("a.rank - (k.upto - k.c)").alias("rank"), F.col("k.x0").alias("lo"), F.col("k.x1").alias("hi"))


def timing(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(group, n, one column for each named quantile, mean, sd, max) of each group."""
    told = exact_quantiles(rows, group, value, tuple(quantiles.values()))
    wide = told.groupBy(group).agg(*[F.max(F.when(F.col("q") == q, F.col(value))).alias(name) for name, q in quantiles.items()])
    rest = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.max(value).alias("max"))
    return rest.join(wide, F.col("of").eqNullSafe(F.col(group))).select(group, "n", *quantiles, "mean", "sd", "max")
