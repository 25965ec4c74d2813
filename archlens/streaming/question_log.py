"""The question log as a stream: JSON lines in, one folded state per entry out.

The state of an entry is its last question and verdict. Entries that see nothing for the retention period are dropped by
event time, so state stays bounded by what the watermark lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "entry_id long, kind string, label string, seq long, at timestamp"
LINE_BYTES = 128 << 10
STATE = "seq long, verdict string"
OUT = "entry_id long, verdict string, seq long"


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Entries of a log's files; torn, oversize and invalid lines are skipped."""
    source = spark.readStream if streaming else spark.read
    lines = source.text(path).where(F.octet_length("value") <= LINE_BYTES)
    rows = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return rows.where("entry_id is not null and kind in ('question', 'verdict') and seq is not null")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log and of the generation before it, ``path.1``, with ``generation`` 0 for the older one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    for n, at in enumerate((path + ".1", path)):
        if hadoop(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(at)):
            rows = read_lines(spark, at).withColumn("generation", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], SCHEMA + ", generation int") if out is None else out


def fold_step(key, frames: Iterator, state) -> Iterator:
    """New entries of one id against its state, in order of seq."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    seq, verdict = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.itertuples():
        if r.kind == "question" and (seq is None or r.seq > seq):
            seq, verdict = int(r.seq), None
        elif r.kind == "verdict" and seq is not None and r.seq > seq:
            verdict = r.label
    if seq is None:
        return
    state.update((seq, verdict))
    if rows["at"].notna().any():
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000) + 90 * 86_400_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"entry_id": [key[0]], "verdict": [verdict], "seq": [seq]})


def folded_stream(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """The state of each entry that changed, in update mode."""
    return entries.withWatermark("at", delay).groupBy("entry_id").applyInPandasWithState(fold_step, OUT, STATE, "update", "EventTimeTimeout")


def questions_by_day(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Questions and verdicts of each day, closed by the watermark."""
    return entries.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "kind", "n")
