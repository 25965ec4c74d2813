"""Packing token sequences by best-fit decreasing.

Texts are tokenised once; overlong documents are cut into full windows at fixed places and the rest of each document
is one piece. A piece's place, length and checksum do not depend on the packing, so only these numbers are shuffled.
Pieces are dealt into bounded buckets by a hash; in each, pieces go in order of falling length into the tightest window
that has room, found by a segment tree over remaining capacities.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import Scratch, sliced

WINDOW = 1024
#: Pieces in a bucket, about; a bucket is one task's work.
BUCKET = 16_384
#: The id that ends each document.
END_ID = 0
#: A run of so much white space is left to ``tokenizers``: the fast engine's matcher backs up over it and runs out of stack.
BLANK = 20_000


def encoder(path: str):
    """texts -> lists of ids, equal to those of the ``tokenizers`` file at path with add_special_tokens=False.

    The file's byte-level BPE is run by a faster engine from the same vocabulary if its ids are the ranks of its merges and it cuts
    texts by the public pattern; that is read from the file. Texts that hold a special token's string, and files of another
    kind, go through ``tokenizers`` itself.
    """
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    blank = re.compile(r"\s{%d}" % BLANK)
    slow = Tokenizer.from_file(path)
    model = json.load(open(path, encoding="utf-8"))
    special = [x["content"] for x in model.get("added_tokens", [])]

    def plain(texts):
        return [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]

    if not ranked(model, public_tokenizers.PATTERN):
        return plain
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(seen))}
    ranks = {bytes(chars[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts):
        out = []
        for t in texts:
            if any(s in t for s in special) or (len(t) >= BLANK and blank.search(t)):
                out.append(plain([t])[0])
                continue
            try:
                out.append(fast.encode_ordinary(t))
            except BaseException as e:  # what the engine throws when its matcher gives up is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
                out.append(plain([t])[0])
        return out

    return encode


def ranked(model: dict, pattern: str) -> bool:
    """Whether a tokenizer file is byte-level BPE that cuts by the pattern and numbers its pieces in the order of their merges."""
    bpe, cut = model["model"], json.dumps(model.get("pre_tokenizer"), ensure_ascii=False)
    if bpe["type"] != "BPE" or "ByteLevel" not in cut or model.get("normalizer") or bpe.get("dropout") or bpe.get("ignore_merges"):
        return False
    said = model["pre_tokenizer"]
    steps = said.get("pretokenizers", [said])
    patterns = [x["pattern"].get("Regex") for x in steps if x.get("type") == "Split"]
    own = any(x.get("use_regex", True) for x in steps if x.get("type") == "ByteLevel")
    if [*patterns, *([pattern] if own and not patterns else [])] != [pattern] or (own and patterns) or any(x.get("add_prefix_space") for x in steps):
        return False
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in bpe["merges"]]
    ids = [bpe["vocab"].get(x, -1) for x in joined]
    return all(a < b for a, b in zip(ids, ids[1:])) and all(i >= 256 for i in ids[:1])


class Capacities:
    """A segment tree over remaining capacities 0..size: which is the least that holds an open window and has room."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.any = bytearray(2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, at: int) -> None:
        at, tree = at + self.half, self.any
        tree[at] = bool(self.open[at - self.half])
        while at > 1:
            at >>= 1
            tree[at] = tree[2 * at] or tree[2 * at + 1]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            self._mark(capacity)

    def take(self, least: int) -> tuple[int, int] | None:
        """(window, capacity) of the tightest window with room for ``least``; it is taken out."""
        tree, at = self.any, least + self.half
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.half:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.half
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity)
        return window, capacity


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each length, in the given order, which best-fit decreasing wants to fall."""
    tree, out, windows = Capacities(window), [], 0
    for n in lengths:
        got = tree.take(n) if n else (0, window)
        if got is None:
            got = (windows, window)
            windows += 1
        at, room = got
        out.append((at, window - room))
        if room > n:
            tree.put(room - n, at)
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): full windows of each document and its rest; salt: a row's place in its task."""

    def work(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(tokenizer)
        row = 0
        for batch in sliced(batches):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt")}
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for i, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                a = np.append(np.asarray(ids, "<u4"), np.asarray([END_ID], "<u4"))
                row += 1
                for at in range(0, len(a), window):
                    part = a[at : at + window]
                    for k, v in (("doc_id", i), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("doc_tokens", len(a)), ("salt", row)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of docs(doc_id, text, ...).

    A document is its ids and an end id, so a null or empty text is a piece of length 1. Pieces of a sequence lie
    without gaps from offset 0 and never exceed ``window`` ids. Rows that repeat a doc_id are packed each. Which pieces share a
    sequence depends on a row's place in its file, so that copies of a text are spread; pieces themselves do not. An
    empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.put(pieces(docs, tokenizer, window), "pieces")
    buckets = max(1, -(-cut.count() // bucket))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "salt", "ids_crc32"), F.lit(buckets)))

    def fill(key, group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("salt", "ascending")])
        placed = np.array(best_fit(group.column("length").to_pylist(), window), np.int64).reshape(-1, 2)
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return dealt.groupBy("bucket").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
