"""Versions of a table behind a pointer that moves by compare and swap, and imports in two steps: preview, then commit of what was seen."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@dataclass
class Pointer:
    """Which table is current: a file for each version, numbered from 1, that holds the place of its table.

    A version is made by creating its file, which fails where there is one; so of two writers that saw the same version one succeeds,
    and no lock is held that a lost writer could leave behind.
    """

    spark: SparkSession
    path: str

    def read(self) -> tuple[int, str | None]:
        """(version, place) of the current table; (0, None) where there is none."""
        fs, where = file_system(self.spark, self.path)
        if not fs.exists(where):
            return 0, None
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        versions = sorted(int(n) for n in names if n.isdigit())
        if not versions:
            return 0, None
        return versions[-1], self.spark.read.text(f"{self.path}/{versions[-1]:020}", wholetext=True).first()[0]

    def swap(self, seen: int, place: str) -> bool:
        """Points to another table if the version is still the one that was seen; else nothing changes."""
        if self.read()[0] != seen:
            return False
        fs, where = file_system(self.spark, f"{self.path}/{seen + 1:020}")
        try:
            out = fs.create(where, False)
        except Exception as e:
            if "Exist" in str(e):
                return False
            raise
        out.write(bytearray(place.encode()))
        out.close()
        return True


@dataclass
class FeedbackStore:
    """Records of feedback (id, split, ...) that are imported in two steps; held-out ones stay as they were first stored."""

    spark: SparkSession
    path: str
    schema: str

    @property
    def pointer(self) -> Pointer:
        return Pointer(self.spark, f"{self.path}/current")

    def table(self) -> tuple[int, DataFrame]:
        version, place = self.pointer.read()
        return version, self.spark.createDataFrame([], self.schema) if place is None else self.spark.read.schema(self.schema).parquet(place)

    def preview(self, incoming: DataFrame) -> tuple[int, DataFrame]:
        """The version that was seen, and (id, action) of each incoming record: add, replace, or refused for one that is held out."""
        version, stored = self.table()
        met = incoming.select("id").distinct().join(stored.select("id", F.col("split").alias("was")), "id", "left")
        return version, met.select("id", F.when(F.col("was").isNull(), "add").when(F.col("was") == "holdout", "refused").otherwise("replace").alias("action"))

    def commit(self, incoming: DataFrame, seen: int) -> bool:
        """Imports what a preview showed, unless another import came between; of records that repeat an id one by value is taken."""
        from archlens.sources.sinks import merge_feedback

        version, stored = self.table()
        if version != seen:
            return False
        rest = [c for c in stored.columns if c != "id"]
        once = incoming.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
        place = f"{self.path}/tables/{uuid.uuid4().hex}"
        merge_feedback(stored, once.select(*stored.columns)).write.parquet(place)
        if self.pointer.swap(seen, place):
            return True
        fs, where = file_system(self.spark, place)
        fs.delete(where, True)
        return False
