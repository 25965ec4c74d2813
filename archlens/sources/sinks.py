"""Sinks: publication with receipts, the log, stores by latest key, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(ValueError):
    """Nothing was published; ``violations`` holds why."""

    def __init__(self, violations: list):
        super().__init__(f"{len(violations)} violations, the first: {violations[:1]}")
        self.violations = violations


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: counts and sums of hashes, so nothing is sorted or collected."""
    columns = [F.to_json(F.struct(*sorted(df.columns)))]
    row = df.select(F.xxhash64(*columns).alias("a"), F.crc32(columns[0].cast("binary")).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum("b").alias("b")).first()
    return f"{row['n']}:{row['a'] or 0}:{row['b'] or 0}"


def publish(tables: dict[str, DataFrame], root: str, snapshot_id: str, violations: DataFrame | None = None) -> dict[str, str]:
    """Writes tables to ``root/snapshot_id=...`` by a staging folder and one rename; returns the receipt, digests by table.

    With any violation nothing is written and what was there stays. A snapshot that is there already is kept: its
    receipt is returned.
    """
    spark = next(iter(tables.values())).sparkSession
    if violations is not None and (found := [r.asDict() for r in violations.limit(20).collect()]):
        raise Rejected(found)
    final, fs = _fs(spark, f"{root}/snapshot_id={snapshot_id}")
    if fs.exists(final):
        return {r["name"]: r["digest"] for r in spark.read.json(f"{root}/snapshot_id={snapshot_id}/receipt").collect()}
    stage = f"{root}/_staging/{snapshot_id}"
    receipt = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
        receipt[name] = digest(spark.read.parquet(f"{stage}/{name}"))
    spark.createDataFrame(sorted(receipt.items()), "name string, digest string").coalesce(1).write.mode("overwrite").json(f"{stage}/receipt")
    fs.mkdirs(final.getParent())
    if not fs.rename(_fs(spark, stage)[0], final):
        raise OSError(f"could not publish {snapshot_id}")
    return receipt


def verify(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """(name) of published tables whose digest is not that of the receipt."""
    base = f"{root}/snapshot_id={snapshot_id}"
    rows = [(r["name"], r["digest"] == digest(spark.read.parquet(f"{base}/{r['name']}"))) for r in spark.read.json(f"{base}/receipt").collect()]
    return spark.createDataFrame(rows, "name string, ok boolean").where("not ok").select("name")


def append_log(entries: DataFrame, path: str) -> None:
    """Appends JSON lines; files of earlier batches are not touched."""
    entries.write.mode("append").json(path)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert of appended rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def export_reviews(folded: DataFrame) -> DataFrame:
    """Review drafts of one project and commit; raises where there are several."""
    if folded.select("project_id", "commit").distinct().limit(2).count() > 1:
        raise ValueError("a review covers one project and commit")
    return folded.select(F.sha2(F.concat_ws("|", "project_id", "entry_id"), 256).alias("id"), "query", "operation", "verdict")


def write_once(df: DataFrame, path: str) -> None:
    """Writes a frozen table; fails where there is one."""
    df.write.mode("errorifexists").parquet(path)


def merge_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records by id: incoming ones replace stored ones but for those that are held out."""
    frozen = stored.where("split = 'holdout'").select("id")
    fresh = incoming.join(frozen, "id", "left_anti")
    return stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def evict(rows: DataFrame, size: str, at: str, key: str, most_rows: int, most_bytes: int, pinned: str) -> DataFrame:
    """Rows that stay in a cache: the pinned one, then the latest within the bounds on number and bytes."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col(key) == pinned), F.desc(at), key)
    told = rows.withColumn("__n", F.row_number().over(order)).withColumn("__b", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return told.where((F.col(key) == pinned) | ((F.col("__n") <= most_rows) & (F.col("__b") <= most_bytes))).drop("__n", "__b")
