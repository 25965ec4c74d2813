"""A log that a stream writes exactly once, and verdicts that meet their questions as both arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.sources.pointers import file_system


@dataclass
class LogSink:
    """JSON lines below ``path``, a folder for each batch: ``generation=g/batch=n``.

    A batch counts once it is committed, which Spark marks by _SUCCESS; what a lost driver left half written has no mark, is not read, and
    is written again under the same number. A batch that comes again after its commit changes nothing. Before a new batch the generation
    is changed if it has grown to ``most_bytes``, so it turns at the border of a batch; the one before is kept, older ones go.
    """

    spark: SparkSession
    path: str
    most_bytes: int = 2 << 20

    def batches(self) -> list[tuple[int, int, bool, int]]:
        """(generation, batch, committed, bytes) of all folders."""
        fs, where = file_system(self.spark, self.path)
        out = []
        for g in fs.listStatus(where) if fs.exists(where) else []:
            if not g.getPath().getName().startswith("generation="):
                continue
            for b in fs.listStatus(g.getPath()):
                if b.getPath().getName().startswith("batch="):
                    mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(b.getPath(), "_SUCCESS")
                    number = lambda x: int(x.getPath().getName().partition("=")[2])
                    out.append((number(g), number(b), fs.exists(mark), fs.getContentSummary(b.getPath()).getLength()))
        return sorted(out)

    def write(self, rows: DataFrame, batch: int) -> None:
        """A batch of a stream, for ``foreachBatch``."""
        there = self.batches()
        mine = [(g, done) for g, b, done, _ in there if b == batch]
        if any(done for _, done in mine):
            return
        current = max((g for g, *_ in there), default=0)
        if mine:
            current = mine[0][0]
        elif sum(n for g, _, done, n in there if g == current and done) >= self.most_bytes:
            current += 1
        rows.write.mode("overwrite").json(f"{self.path}/generation={current}/batch={batch}")
        fs, _ = file_system(self.spark, self.path)
        for g in {g for g, *_ in there if g < current - 1}:
            fs.delete(file_system(self.spark, f"{self.path}/generation={g}")[1], True)

    def read(self, schema: str) -> DataFrame:
        """Lines of committed batches with ``generation`` and ``batch``; a line that does not parse is left out."""
        parts = [f"{self.path}/generation={g}/batch={b}" for g, b, done, _ in self.batches() if done]
        if not parts:
            return self.spark.createDataFrame([], schema + ", generation int, batch int")
        lines = self.spark.read.option("basePath", self.path).text(parts)
        rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "generation", "batch", F.try_parse_json("value").isNotNull().alias("fine"))
        return rows.where("fine").select("e.*", F.col("generation").cast("int").alias("generation"), F.col("batch").cast("int").alias("batch"))


def answered(questions: DataFrame, verdicts: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """(entry_id, seq, at, verdict_seq, label, said_at): verdicts with the questions of their entry that they follow within a time.

    questions(entry_id, seq, at), verdicts(entry_id, seq, label, at), both streams or both tables. Of streams each side waits as long as the
    other may still bring a partner: state is bounded by ``within`` and ``delay``. A row later than its watermark is dropped, and counted in the
    progress of the query.
    """
    q = questions.select("entry_id", "seq", "at").withWatermark("at", delay)
    v = verdicts.select(F.col("entry_id").alias("of"), F.col("seq").alias("verdict_seq"), "label", F.col("at").alias("said_at")).withWatermark("said_at", delay)
    met = q.join(v, (F.col("entry_id") == F.col("of")) & (F.col("said_at") >= F.col("at")) & (F.col("said_at") <= F.col("at") + F.expr(f"interval {within}")))
    return met.select("entry_id", "seq", "at", "verdict_seq", "label", "said_at")


def late_rows(query) -> int:
    """How many rows a query's stateful operators have dropped because they came after their watermark."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
