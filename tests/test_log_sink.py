"""A log written exactly once, verdicts joined as a stream, and pointers that two writers want to move."""

from datetime import datetime, timedelta

import pytest

from archlens.sources.pointers import FeedbackStore, Pointer
from archlens.streaming.log_sink import LogSink, answered, late_rows

SCHEMA = "id long, what string"


def seen(sink):
    return sorted((r["id"], r["what"]) for r in sink.read(SCHEMA).collect())


def test_each_line_counts_once(spark, tmp_path):
    frame = lambda *ids: spark.createDataFrame([(i, f"line {i}") for i in ids], SCHEMA)
    sink = LogSink(spark, str(tmp_path / "log"))
    assert seen(sink) == []
    sink.write(frame(1, 2), 0)
    half = tmp_path / "log" / "generation=0" / "batch=1"  # a driver was lost while it wrote batch 1
    half.mkdir()
    (half / "part-0.json").write_text('{"id": 3, "what": "line 3"}\n{"id": 4, "wh')
    assert [i for i, _ in seen(sink)] == [1, 2]
    again = LogSink(spark, str(tmp_path / "log"))
    again.write(frame(1, 2), 0)
    again.write(frame(3, 4), 1)
    again.write(frame(3, 4), 1)
    assert [i for i, _ in seen(again)] == [1, 2, 3, 4]
    part = next((tmp_path / "log" / "generation=0" / "batch=1").glob("part-*"))
    part.with_name("part-x.json").write_text('{"id": 9, "wha')  # torn by another writer
    assert [i for i, _ in seen(again)] == [1, 2, 3, 4]


def test_generations_turn_at_batches(spark, tmp_path):
    sink = LogSink(spark, str(tmp_path / "log"), most_bytes=60)
    for n in range(8):
        sink.write(spark.createDataFrame([(n, "x" * 20)], SCHEMA), n)
    kept = {(g, b) for g, b, done, _ in sink.batches() if done}
    assert max(g for g, _ in kept) >= 2 and len({g for g, _ in kept}) == 2 and max(b for _, b in kept) == 7
    assert [i for i, _ in seen(sink)] == sorted(b for _, b in kept)
    sink.write(spark.createDataFrame([(99, "again")], SCHEMA), 7)
    assert 99 not in [i for i, _ in seen(sink)]


def test_a_stream_that_is_stopped_goes_on(spark, tmp_path):
    sink, calls = LogSink(spark, str(tmp_path / "log")), []

    def start(write):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()

    def dies(rows, batch):
        sink.write(rows, batch)
        calls.append(batch)
        if batch == 1:
            raise RuntimeError("lost after the write, before the stream knew")

    for i in range(3):
        spark.createDataFrame([(i, "a"), (i + 10, "b")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost after the write"):
        start(dies)
    start(sink.write)
    assert [i for i, _ in seen(sink)] == [0, 1, 2, 10, 11, 12]


def test_verdicts_meet_questions(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    slices = [
        [(1, "question", 1, None, at(0)), (2, "question", 2, None, at(1)), (1, "verdict", 3, "match", at(2)), (3, "verdict", 4, "early", at(2))],
        [(3, "question", 5, None, at(30)), (2, "verdict", 6, "no match", at(31)), (1, "question", 7, None, at(400))],
        [(9, "question", 20, None, at(401)), (9, "verdict", 21, "match", at(401))],  # a watermark counts for what comes two batches later
        [(1, "verdict", 8, "late", at(3)), (1, "verdict", 9, "unsure", at(402)), (3, "verdict", 10, "too long after", at(401))],
    ]
    schema = "entry_id long, kind string, seq long, label string, at timestamp"
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    side = lambda kind: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where(f"kind = '{kind}'")
    sink = LogSink(spark, str(tmp_path / "out"))
    run = answered(side("question"), side("verdict")).writeStream.foreachBatch(sink.write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["entry_id"], r["seq"], r["verdict_seq"]) for r in sink.read("entry_id long, seq long, verdict_seq long").collect())
    table = spark.createDataFrame([r for rows in slices for r in rows], schema)
    whole = sorted((r["entry_id"], r["seq"], r["verdict_seq"]) for r in answered(table.where("kind = 'question'"), table.where("kind = 'verdict'")).collect())
    assert got == [(1, 1, 3), (1, 7, 9), (2, 2, 6), (9, 20, 21)] and [x for x in whole if x not in got] == [(1, 1, 8)]
    assert late_rows(run) == 1


def test_of_two_writers_one_moves_the_pointer(spark, tmp_path):
    a, b = Pointer(spark, str(tmp_path / "p")), Pointer(spark, str(tmp_path / "p"))
    assert a.read() == (0, None) and a.swap(0, "one") and not b.swap(0, "two") and b.read() == (1, "one")
    (tmp_path / "p" / f"{2:020}").write_text("three")  # between b's look and its write
    real, b.read = b.read, lambda: (1, "one")
    assert not b.swap(1, "two")
    b.read = real
    assert a.read() == (2, "three") and a.swap(2, "four") and a.read() == (3, "four")


def test_imports_in_two_steps(spark, tmp_path):
    schema = "id long, split string, label int"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    store = FeedbackStore(spark, str(tmp_path / "store"), schema)
    assert store.commit(frame((1, "holdout", 0), (2, "dev", 0)), store.preview(frame())[0])
    mine, other = frame((1, "dev", 1), (2, "dev", 1), (3, "dev", 1)), frame((4, "dev", 4))
    version, shown = store.preview(mine)
    assert sorted((r["id"], r["action"]) for r in shown.collect()) == [(1, "refused"), (2, "replace"), (3, "add")]
    assert store.commit(other, version) and not store.commit(mine, version)
    assert sorted(tuple(r) for r in store.table()[1].collect()) == [(1, "holdout", 0), (2, "dev", 0), (4, "dev", 4)]
    assert store.commit(mine, store.preview(mine)[0])
    assert sorted(tuple(r) for r in store.table()[1].collect()) == [(1, "holdout", 0), (2, "dev", 1), (3, "dev", 1), (4, "dev", 4)]
