"""What the operators of this subpackage share: tables, scratch tables, batches and runs of equal keys."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the ASCII white space characters. ``bytes.split()`` splits the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker turns into objects at once; Spark itself bounds the bytes of an Arrow batch (64 MB by default).
BATCH_ROWS = 512
#: Rows from which on a table is joined by sorting: Spark sizes what is read by compressed files, and what is exploded by one row of it.
WIDE_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="archlens-checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and a lost executor costs no recomputation.

    ``drop`` deletes what no later step reads, ``keep`` all but what a lazy result still reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths, self.number = spark, f"{shared_dir(spark)}/archlens-{uuid.uuid4().hex}", {}, 0
        self._path, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self._delete, self.base)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # at the driver's end the JVM may be gone
            self._path(path).getFileSystem(self._conf).delete(self._path(path), True)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{self.number}"
        self.number += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            path, _ = self.paths.pop(id(df))
            self._delete(path)

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        left = {id(df) for df in frames}
        self.drop(*[df for key, (_, df) in list(self.paths.items()) if key not in left])


def wide(df: DataFrame, rows: int) -> DataFrame:
    """df, never to be broadcast if it may have so many rows; nor is what is selected, exploded or grouped from it."""
    return df.hint("merge") if rows > WIDE_ROWS else df


def sliced(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches of at most so many rows: bounds the objects that a Python worker holds, whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 modulo 5: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows outside the held-out fold, lowest hash first.

    ``limit`` bounds the sample whatever the size of the corpus. Rows with a null label or id take no part;
    an id that is labelled more than once counts once, with its highest label; of several texts of an id the first by value is taken.
    """
    picked = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def runs(batches: Iterator, key: str, least: int = 4096) -> Iterator:
    """Tables of whole runs of equal keys, from batches sorted by key; the caller bounds the length of a run."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least or held[0].column(key)[0].equals(batch.column(key)[-1]):
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key)
        last = keys[-1]
        cut = pc.index(keys, last).as_py()
        if cut:
            yield whole.slice(0, cut)
        rest = whole.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
