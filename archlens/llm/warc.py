"""WARC archives: one gzip member per record.

Archives are written as rows of a table (one binary value for each archive of bounded size), so they lie wherever Spark can
write. The reader is sequential: it inflates one member after the other in small steps, frames the record by
its content length and verifies block and payload digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import Scratch, sliced

#: Bytes of payload after which an archive is closed, and bytes inflated at a time.
ARCHIVE_BYTES, STEP = 16 << 20, 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of page ``refers_to`` without."""
    import gzip
    import uuid

    block = HTTP if refers_to is not None else HTTP + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uri}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream, its content in steps; the stream is read once, in order."""
    import zlib

    source, left = iter(chunks), b""

    def inflate(first):
        nonlocal left
        engine, data = zlib.decompressobj(31), first
        while True:
            out = engine.decompress(data, STEP)
            if out:
                yield out
            if engine.eof:
                left = engine.unused_data
                return
            data = engine.unconsumed_tail or next(source, b"")
            if not data:
                raise ValueError("archive ends inside a member")

    while True:
        while not left:
            left = next(source, None)
            if left is None:
                return
        one = inflate(left)
        yield one
        for _ in one:  # what the caller hasn't read
            pass


def read(chunks: Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record; raises ValueError on a false frame or digest."""
    for steps in members(chunks):
        data = bytearray()
        for step in steps:
            data += step
            if (end := data.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("record without an end of headers")
        first, *lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["Content-Length"])
        del data[: end + 4]
        for step in steps:
            data += step
        if len(data) != length + 4 or bytes(data[length:]) != b"\r\n\r\n":
            raise ValueError("content length does not frame the record")
        block = bytes(data[:length])
        if headers.get("WARC-Block-Digest") not in (None, f"sha1:{digest(block)}"):
            raise ValueError("block digest differs")
        if headers["WARC-Type"] == "response" and headers.get("WARC-Payload-Digest") not in (None, f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}"):
            raise ValueError("payload digest differs")
        yield headers, block


def first_pages(rows: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """(page, same, refers_to) of the pages that revisit another: rows(page_id, same, bytes), same: the payload's digest.

    Only ids and digests are grouped and joined, as tables on either side, so a payload that a third of all pages has is split.
    """
    light = scratch.put(rows.where(F.col("bytes") >= least).select("page_id", "same"), "digests")
    first = scratch.put(light.groupBy(F.col("same").alias("s")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    met = light.join(first, F.col("same") == F.col("s")).where("page_id <> first")
    return met.select(F.col("page_id").alias("page"), "same", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, least: int = 0, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive) for pages(page_id, url, html): binary archives, each of bounded size.

    Of equal payloads of ``least`` bytes or more the smallest page_id is a response and the others revisit it; payloads count as equal if
    their SHA-1 agrees, which is what a revisit by identical payload digest says. Payloads are dealt by page, never by digest.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha1("payload")))
    again = first_pages(rows.select("page_id", "same", F.octet_length("payload").alias("bytes")), Scratch(pages.sparkSession), least).withColumnRenamed("same", "digest")
    told = rows.join(again, (F.col("page_id") == F.col("page")) & (F.col("same") == F.col("digest")), "left").select("page_id", "url", "payload", "refers_to")

    def work(batches):
        import pyarrow as pa

        parts, held = [], 0
        for batch in sliced(batches, 128):
            for r in batch.to_pylist():
                parts.append(record(r["page_id"], r["url"], r["payload"], r["refers_to"]))
                held += len(parts[-1])
                if held >= size:
                    yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})

    return told.mapInArrow(work, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""

    def work(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for data in batch.column("archive"):
                view = memoryview(data.as_buffer())
                rows = []
                for h, block in read(bytes(view[at : at + STEP]) for at in range(0, len(view), STEP)):
                    rows.append((number(h["WARC-Page-ID"]), h["WARC-Target-URI"], number(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].partition(":")[2], h["WARC-Type"], number(h.get("WARC-Refers-To-Page-ID"))))
                    if h["WARC-Type"] == "response" and len(block.partition(b"\r\n\r\n")[2]) != rows[-1][2]:
                        raise ValueError("payload length differs")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each row of pages, from written archives read back.

    A null html is an empty payload, a null url an empty one, a null page_id stays null (and is a response). Rows that
    repeat the smallest page_id of a payload are all responses. An empty table gives an empty result; further columns are
    ignored.
    """
    scratch = Scratch(pages.sparkSession)
    return read_archives(scratch.put(write_archives(pages, least), "archives")).drop("url")


#: The same for DuckDB but for the digest's base32, which it lacks: built from hex by five-bit groups.
ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex from p),
bits as (select page_id, payload_bytes, hex,
  array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + cast('0x' || substr(hex, i, 1) as integer)), 4)), '') as b from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: cast(substr(b, 1 + i * 5 + j, 1) as integer) * (1 << (4 - cast(j as integer)))))::int, 1)), '') as payload_digest,
  case when page_id = min(page_id) over (partition by hex) then 'response' else 'revisit' end as record_type,
  case when page_id <> min(page_id) over (partition by hex) then min(page_id) over (partition by hex) end as refers_to
from bits
"""
