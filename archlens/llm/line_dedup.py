"""Lines that many documents share are kept in one document only.

A line's key is hashed (128 bits) where its document lies. Hashes are dealt to tasks by equal ranges of their values, which needs
no sampling since hashes are even, and sorted within a task by hash, falling document and position: the first document met of a
hash is the one that keeps its lines, and from the third on all but the first lose theirs. A task holds no more than the lines
of one hash in one document. What comes back is no text but, for each document that loses lines, a compressed bitmap.

A key that a third of all lines have is no hot task: before the shuffle a task passes on, for each key of a run of lines, the
three largest documents only. Lines of further documents are settled, since two larger documents and the survivor exist, and go
straight to their documents' bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import sliced

#: Code points of a key and documents that hold it, at least, for its lines to be dropped.
LEAST_LENGTH, LEAST_DOCS = 20, 3
BLANKS = "\t\n\x0b\x0c\r "
#: Lines that a task looks at together before it passes on the largest documents of their keys.
RUN = 100_000


def _rank(doc_id) -> tuple:
    """Documents in order: one without id before all others."""
    return (doc_id is not None, doc_id or 0)


def _hits(docs: DataFrame, least: int, many: int) -> DataFrame:
    """(key, place, doc_id, row, at): positions ``at`` of a key in a row's text; a null key: settled, these lines go.

    place is the range that the key falls into, or for settled lines one by their document, so that copies of a text part.
    """
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator):
        import pyarrow as pa
        import xxhash

        lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        schema = pa.schema([("key", pa.binary()), ("place", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.list_(pa.int32()))])

        def passed(held: dict) -> Iterator:
            out: list[tuple] = []
            for key, met in held.items():
                left = None
                if len(met) > many:
                    ranks = sorted({_rank(d) for d, _ in met}, reverse=True)
                    left = ranks[many - 1] if len(ranks) > many else None
                place = int.from_bytes(key[:4]) * places >> 32
                for (doc, row), at in met.items():
                    if left is None or _rank(doc) >= left:
                        out.append((key, place, doc, row, at))
                    else:
                        out.append((None, (hash((doc or 0, row)) & 0xFFFFFFFF) * places >> 32, doc, row, at))
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000], strict=True), schema.types, strict=True)], schema=schema)

        held: dict = {}
        lines = 0
        for batch in sliced(batches):
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                own: dict = {}
                for at, line in enumerate(text.split("\n")):
                    key = line.strip(BLANKS)
                    if len(key) >= least:
                        own.setdefault(xxhash.xxh3_128_digest(key.translate(lower) if not key.islower() else key), []).append(at)
                for key, at in own.items():
                    held.setdefault(key, {})[doc, row] = at
                lines += len(own)
                if lines >= RUN:
                    yield from passed(held)
                    held, lines = {}, 0
        yield from passed(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(work, "key binary, place int, doc_id long, row long, at array<int>")


def _losers(hits: Iterator, many: int) -> Iterator:
    """(doc_id, row, at) of lines that go, from hits in order of key and falling document."""
    for key, met in groupby(hits, key=itemgetter(0)):
        if key is None:
            yield from (h[1:] for h in met)
            continue
        docs, last, waiting = 0, None, []
        for _, doc, row, at in met:
            if not docs or doc != last:
                docs, last = docs + 1, doc
            if docs == 1:
                continue
            if docs < many:
                waiting.append((doc, row, at))
                continue
            yield from waiting
            waiting = []
            yield doc, row, at


def keep_bitmaps(docs: DataFrame, least: int = LEAST_LENGTH, many: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row, n_dropped, keep) for each document of docs(doc_id, text, ...) that loses lines.

    row is xxhash64 of the text. keep is a zlib-compressed bitmap, lowest bit first: bit i is 1 if line i stays, and so do lines beyond its
    end. Keys of at least ``least`` code points that are found in at least ``many`` documents lose all lines except in the largest doc_id
    holding it. Rows that repeat an id count as one document; rows without id are one document, smaller than all others. Rows
    of equal id and text have one bitmap.
    """
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _hits(docs, least, many).repartitionById(places, F.col("place")).drop("place")
    sorted_ = dealt.sortWithinPartitions("key", F.col("doc_id").desc_nulls_last(), "row", "at")

    def stream(batches: Iterator):
        import pyarrow as pa

        def flat():
            for batch in sliced(batches, 8192):
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "row", "at")), strict=True)

        def batch_of(rows):
            doc, row, at = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "row", "at"])

        out = []
        for hit in _losers(flat(), many):
            out.append(hit)
            if len(out) == 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    # A set: rows of equal id and text send the same positions, which merge before and after the shuffle.
    gone = sorted_.mapInArrow(stream, "doc_id long, row long, at array<int>").groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))

    def bitmaps(batches: Iterator):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            n, keep = [], []
            for lists in batch.column("at").to_pylist():
                at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
                bits = np.ones(int(at[-1]) // 8 * 8 + 8, np.uint8)  # whole bytes, so that filling bits keep their lines too
                bits[at] = 0
                n.append(len(at))
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "row", "n_dropped", "keep"])

    return gone.mapInArrow(bitmaps, "doc_id long, row long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> str:
    """The lines of a text that its bitmap keeps."""
    import zlib

    import numpy as np

    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    return "\n".join([x for x, b in zip(lines, bits.tolist(), strict=False) if b] + lines[len(bits) :])


def without_shared_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of docs, its text without the lines that its bitmap drops."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            left = [kept_lines(t, k) for t, k in zip(texts, batch.column("keep").to_pylist(), strict=True)]
            made = [pa.array([t.count("\n") + 1 for t in texts], pa.int64()), batch.column("n_dropped"), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_lines", "n_dropped", "text"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    maps = bitmaps.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_dropped", "keep")
    met = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return met.select("doc_id", "text", "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")).mapInArrow(work, "doc_id long, n_lines long, n_dropped long, text string")


def line_dedup(docs: DataFrame, least: int = LEAST_LENGTH, many: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of docs(doc_id, text, ...): its text without lines that other documents keep.

    Texts are split at newlines; a null or empty text is one empty line and stays empty. A line's key is the line without ASCII white
    space at both ends, A-Z in lower case. ``keep_bitmaps`` says which lines go and what repeated and null ids mean. A document all
    of whose lines go keeps an empty text. An empty table gives an empty result; further columns are ignored.
    """
    return without_shared_lines(docs, keep_bitmaps(docs, least, many))


#: The same for DuckDB, with the sha256 of what is kept in its place.
ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as (
  select key, max(doc_id) as holder from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (
  select k.*, s.holder is not null and s.holder <> k.doc_id as gone from keyed k left join shared s using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
