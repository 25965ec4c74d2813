"""Mixing sources to target weights by hash-threshold histograms. Built-in functions only.

Every document has a hash that depends on its id alone. What a source takes is nested in its hash: of a target of
2.3 times the source, each document is taken twice, and a third time those below the hash at which the sum of sizes
reaches the remaining 0.3. That threshold is found from sums by (source, hash bucket): the bucket in which the budget
ends is refined by the next bits, the others are settled, and nothing is sorted. Only the boundary bucket's rows are
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import WORD, Scratch

#: Weights of the sources in order of their code points, null last, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Bits of a document's hash, and bits that one refinement settles.
HASH_BITS, STEP_BITS = 60, 12


def hash_of(column: str):
    """60 bits of the md5 of an id as text; the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, none above ``most`` times the source.

    What a cap cuts off is shared again by weight until no source is above its cap. That ends at one level L with
    target = min(cap, weight * L): sources are capped in order of cap / weight. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    stepped = weighed.withColumn("level", level).withColumn("capped", most * F.col("source_size") <= F.col("weight") * F.col("level"))
    # The first source that keeps below its cap sets the level for all that follow.
    common = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "rank", "level"))).over(Window.partitionBy(F.lit(1)))["level"]
    return stepped.withColumn("common", common).select("source", "source_size", F.when(F.col("common").isNull() | F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("common")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of each row, and (of, source_size, target, full, end) of each source: a row is taken ``full``
    times, and once more if its hash is below ``end``."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.put(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), hash_of("doc_id").alias("hash")), "sizes")
    goal = scratch.put(targets(rows, weights, most).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size")), "targets")

    # Settled below ``low``; the boundary lies in the bucket of ``width`` bits that starts there.
    edge = goal.select("source", F.lit(0).cast("long").alias("low"), "budget", F.lit(0).cast("long").alias("done"), F.lit(False).alias("over"))
    rest = rows
    for left in range(HASH_BITS, 0, -STEP_BITS):
        bits = left - STEP_BITS
        here = rest.join(edge.select(F.col("source").alias("s"), "low").where("not over"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + (1 << left)))
        sums = here.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("from"), F.max("hash").alias("to"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = sums.withColumn("upto", F.sum("n").over(running)).join(edge.select(F.col("source").alias("s"), "budget", "done"), F.col("source").eqNullSafe(F.col("s")))
        # The first bucket that would end above the budget.
        found = steps.where(F.col("done") + F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n", "from", "to")).alias("b"))
        joined = edge.withColumnRenamed("source", "s").join(found, F.col("s").eqNullSafe(F.col("source")), "left")
        edge = scratch.put(
            joined.select(
                F.col("s").alias("source"),
                F.when(F.col("b").isNotNull(), F.shiftleft(F.col("b.bucket"), bits)).when(F.col("over"), F.col("low")).otherwise(F.lit(1 << HASH_BITS)).cast("long").alias("low"),
                "budget",
                (F.col("done") + F.coalesce(F.col("b.before"), F.lit(0))).alias("done"),
                (F.col("b").isNull()).alias("over"),
                F.coalesce(F.col("b.n"), F.lit(0)).alias("last"),
                F.col("b.from").alias("at"),
                F.coalesce(F.col("b.from") < F.col("b.to"), F.lit(False)).alias("mixed"),
            ),
            "edge",
        )
        was = rest
        if not edge.where("mixed").limit(1).count():
            break
        if bits:
            open_ = edge.where("not over").select(F.col("source").alias("s"), F.col("low").alias("from"))
            rest = scratch.put(here.drop("s", "low").join(open_, F.col("source").eqNullSafe(F.col("s"))).where((F.col("hash") >= F.col("from")) & (F.col("hash") < F.col("from") + (1 << bits))).drop("s", "from"), "rest")
        if was is not rows:
            scratch.drop(was)
    # ``at`` is now the hash at which the budget is passed; it is taken too where that ends nearer.
    near = F.col("done") + F.col("last") - F.col("budget") <= F.col("budget") - F.col("done")
    end = edge.select(F.col("source").alias("s"), F.when(F.col("over"), F.col("low")).otherwise(F.col("at") + near.cast("long")).alias("end"))
    return rows, goal.join(end, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), "source_size", "target", "full", "end")


def copies():
    return F.col("full") + (F.col("hash") < F.col("end")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source, ...).

    size is the number of words of the whole text (null: 0), taken the words that the mix takes of it, repeats counted:
    a multiple of size. A null source is a source of its own, the last. Rows of one source whose ids agree share a hash
    and are taken together; the last such group is taken where that ends nearer to the target. A source without
    words has target 0 and takes nothing. Reruns agree, whatever the partitioning. An empty table gives an empty
    result; further columns are ignored.
    """
    rows, by_source = plan(docs, weights, most)
    return rows.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as `mix` takes it. Texts are not shuffled: only the small table of sources is joined."""
    _, by_source = plan(docs, weights, most)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").cast("string").alias("__source"), hash_of("doc_id").alias("hash"))
    taken = own.join(by_source, F.col("__source").eqNullSafe(F.col("of"))).select("doc", copies().alias("copies")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


#: The same for DuckDB: the threshold from a running sum in hash order.
ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as hash
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) as rank from per),
weighed as (select *, 1 + (rank - 1) % 3 as weight from ranked),
stepped as (
  select *, cast(sum(source_size) over () - 3 * coalesce(sum(source_size) over w, 0) as double)
    / cast(sum(weight) over () - coalesce(sum(weight) over w, 0) as double) as level
  from weighed window w as (order by source_size / weight, rank rows between unbounded preceding and 1 preceding)),
common as (select level from stepped where not 3 * source_size <= weight * level order by source_size / weight, rank limit 1),
goal as (
  select source, source_size, case when 3 * source_size <= weight * level or (select level from common) is null
    then cast(3 * source_size as double) else weight * (select level from common) end as target
  from stepped),
plan as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as full_copies from goal),
running as (
  select s.doc_id, s.size, p.source_size, p.target, p.full_copies, p.target - p.full_copies * p.source_size as budget,
    sum(s.size) over (partition by s.source order by s.hash range between unbounded preceding and current row) as upto,
    sum(s.size) over (partition by s.source, s.hash) as tied
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(size * (full_copies + case
    when upto <= budget then 1
    when upto - tied <= budget and upto - budget <= budget - (upto - tied) then 1 else 0 end) as bigint) as taken
from running
"""
