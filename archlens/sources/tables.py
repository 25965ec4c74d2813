"""The test tables seen as a code map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.operators.graph import adjacency


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files from which on joins with them are not broadcast: their size is estimated from compressed columns, and paths are long.
WIDE = 200_000


def code_files(spark: SparkSession, sf_dir: str, joined: bool = True) -> DataFrame:
    """fid, path, folder, stem, top, lines: a file for each part. Many files are joined by sorting both sides, unless ``joined`` is false."""
    files = _files(spark, sf_dir)
    return files.hint("merge") if joined and table(spark, sf_dir, "part").count() > WIDE else files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.lower(F.regexp_replace("p_brand", "#", ""))
    mid = F.lower(F.substring_index("p_type", " ", 1))
    stem = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("fid"), F.concat(top, F.lit("/"), mid, F.lit("/"), stem, F.lit(".py")).alias("path"), F.concat(top, F.lit("/"), mid).alias("folder"), stem.alias("stem"), top.alias("top"), F.col("p_size").alias("lines")
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type with multiplicity: a reference for each order."""
    n = table(spark, sf_dir, "part").count()
    kind = F.when(F.col("o_orderpriority").startswith("5") & (F.col("o_orderstatus") == "P"), "realtime")
    kind = kind.when(F.col("o_orderstatus") == "F", "import").when(F.col("o_orderstatus") == "O", "http").otherwise("rpc")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("src"), (F.col("o_orderkey") % n).alias("dst"), kind.alias("type"))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).distinct()


def path_edges(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """Edges by path, with the groups and folders of both ends."""
    files = code_files(spark, sf_dir)
    a = files.select(F.col("fid").alias("src"), F.col("path").alias("a"), F.col("top").alias("src_top"), F.col("folder").alias("src_folder"))
    b = files.select(F.col("fid").alias("dst"), F.col("path").alias("b"), F.col("top").alias("dst_top"), F.col("folder").alias("dst_folder"))
    edges = code_edges(spark, sf_dir) if edges is None else edges
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "src_top", "dst_top", "src_folder", "dst_folder")


def file_graph(spark: SparkSession, sf_dir: str, reverse: bool = False, types: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """pairs and names as `graph.search` takes them: what `adjacency` of `path_edges` is, by the numbers of files, which are shorter than paths."""
    return {"pairs": adjacency(refs(spark, sf_dir), reverse, types), "names": code_files(spark, sf_dir).select(F.col("fid").alias("key"), F.col("path").alias("id"))}


def group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_edges(spark, sf_dir).where("src_top <> dst_top").groupBy(F.col("src_top").alias("src"), F.col("dst_top").alias("dst"), "type").agg(F.count("*").alias("weight"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, path: the first file of each top folder, one for each of a batch of questions."""
    return code_files(spark, sf_dir, joined=False).groupBy("top").agg(F.min("path").alias("path")).select(F.row_number().over(Window.orderBy("path")).cast("long").alias("qid"), "path")


#: Confidence of a call from strongest to weakest.
TIERS = ("resolved", "instance-local", "typed", "through-decorator")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, id, name, qualname, path, decorated, entry_point, lines: a definition in each file."""
    name = F.substring_index("stem", "_", 1)
    lines = F.col("lines")
    return code_files(spark, sf_dir).select(
        F.col("fid").alias("sid"), F.concat("path", F.lit("#"), name, F.lit("@1")).alias("id"), name.alias("name"), F.regexp_replace("stem", "_[0-9]+$", "").alias("qualname"), "path",
        (lines % 5 == 0).alias("decorated"), (lines % 10 == 0).alias("entry_point"), "lines",
    )


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, confidence, path, line, position: a call for each line item; dst is null where it is not resolved."""
    n = table(spark, sf_dir, "part").count()
    symbols = code_symbols(spark, sf_dir)
    a, b = symbols.select(F.col("sid").alias("l_partkey"), F.col("id").alias("src"), "path"), symbols.select(F.col("sid").alias("to"), F.col("id").alias("dst"))
    number = F.col("l_linenumber")
    tier = F.when(number <= 3, TIERS[0]).when(number == 4, TIERS[1]).when(number == 5, TIERS[2]).when(number == 6, TIERS[3]).otherwise("unresolved")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % n).alias("to"), "l_linenumber", "l_quantity", "l_orderkey")
    return items.join(a, "l_partkey").join(b, "to").select("src", F.when(number < 7, F.col("dst")).alias("dst"), tier.alias("confidence"), "path", (F.col("l_quantity") + 1).cast("int").alias("line"), F.col("l_orderkey").alias("position"))


def numbered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, confidence of the sites of `call_sites` that have a dst, by the numbers of definitions, which are shorter than their ids."""
    number, n = F.col("l_linenumber"), table(spark, sf_dir, "part").count()
    tier = F.when(number <= 3, TIERS[0]).when(number == 4, TIERS[1]).when(number == 5, TIERS[2]).otherwise(TIERS[3])
    return table(spark, sf_dir, "lineitem").where("l_linenumber < 7").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % n).alias("dst"), tier.alias("confidence"))


def symbol_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """calls(src, dst, tier) and names as `graph.search` takes them: what `call_edges` is, by the numbers of definitions."""
    calls = numbered_sites(spark, sf_dir).groupBy("src", "dst").agg(F.max(tier_rank()).alias("tier"))
    return {"calls": calls, "names": symbol_ids(spark, sf_dir)}


def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id): the number of each definition and its id."""
    return code_symbols(spark, sf_dir).select(F.col("sid").alias("key"), "id").where("id is not null")


def tier_rank(column: str = "confidence"):
    return F.array_position(F.array(*map(F.lit, TIERS)), F.col(column))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, tier: the weakest of a pair's sites, 1 is strongest."""
    return call_sites(spark, sf_dir).where("dst is not null").groupBy("src", "dst").agg(F.max(tier_rank()).alias("tier"))
