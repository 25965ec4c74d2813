"""Near duplicates by an inverted join of MinHash coordinates.

1. Each text becomes a set of hashed word shingles, a signature of ``COORDS`` minima and a sketch (one byte of
   each). Texts with equal sets are one class at once, whatever their number.
2. Prefix: a pair that agrees on ``MATCHES`` coordinates or more agrees on one of the first
   ``COORDS - MATCHES + 1``; only these are posted, under (coordinate, value). Posting lists of one class go.
3. Merging: inside a list the collisions of classes are counted, ``SKIP`` coordinates after the other; classes that can no
   longer reach the match threshold are skipped. Only a spanning forest of the collisions leaves the task, never all pairs.
4. Classes that collisions connect are confirmed together on full shingle sets, each set moved once for a
   block of ``BLOCK`` classes: one set is compared with all others that collide with it and are not yet in its component.
   Only links of a spanning forest leave the task; components are built from these.
5. Where keys have lists of over ``LONGEST`` classes, their classes count such keys last: any order of coordinates that all
   share will do for a prefix, so rarer ones, of all ``COORDS``, are posted instead. What is still too long is compared with
   ``PIVOTS`` of its own classes; what the best of these joins is one group, and is only compared with the rest, block
   by block and with blocks of a fitting set size. Nothing is left out; a table all of whose texts consist of the same few
   passages costs the square of its rows.

A pair of similarity 0.8 agrees on 64 * 0.8 = 51 coordinates on average, with a deviation of 3.2; at a threshold
of 38 it is missed with a chance of about 1e-5, and a more similar pair with less.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.bloom import build_filter
from archlens.llm.common import WIDE_ROWS, Scratch, runs, sliced, wide
from archlens.llm.components import components

COORDS, MATCHES = 64, 38
PREFIX = COORDS - MATCHES + 1
#: Coordinates that are counted before classes are skipped.
SKIP = 16
#: Classes in a posting list that one task compares at most.
LONGEST = 4096
#: Classes of a too long list that are compared with its pivots at once.
WINDOW = 512
#: Classes, and bytes of shingle sets, in a block; a task confirms two blocks at a time.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Blocks beyond which a group is first compared with as many of its own classes.
HUGE, PIVOTS = 8, 8


def _shingles(text: str | None, k: int, memo: dict):
    """The distinct k-word shingles of a text as sorted 64-bit hashes."""
    import numpy as np
    import xxhash

    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words) + 1)], np.uint64)
    if len(memo) > 500_000:
        memo.clear()
    get, digest = memo.get, xxhash.xxh3_64_intdigest
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = memo[w] = digest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    mixed = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _set_hash(s) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _digest(text):
    """A column that tells texts apart; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, n_shingles, set_hash, low, sketch); low, the minima, and set_hash are null for an empty set."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20_011)
        mul = rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, COORDS, dtype=np.uint64)
        memo: dict = {}
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("low", pa.list_(pa.int32())), ("sketch", pa.binary())])
        for batch in sliced(batches):
            n, set_hash, lows, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = _shingles(text, k, memo)
                n.append(len(s))
                if not len(s):
                    for c in (set_hash, lows, sketch):
                        c.append(None)
                    continue
                low = np.full(COORDS, 0xFFFFFFFF, np.uint64)
                for at in range(0, len(s), 1024):
                    part = s[at : at + 1024]
                    np.minimum(low, ((part[None, :] * mul[:, None] + add[:, None]) >> np.uint64(32)).min(axis=1), out=low)
                set_hash.append(_set_hash(s))
                lows.append(low.astype(np.uint32).view(np.int32).tolist())
                sketch.append((low ^ (low >> np.uint64(8)) ^ (low >> np.uint64(16))).astype(np.uint8).tobytes())
            made = [pa.array(c, f.type) for c, f in zip((n, set_hash, lows, sketch), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *made], schema=schema)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id long, digest binary, n_shingles long, set_hash binary, low array<int>, sketch binary")


def colliding(sk, rest, i):
    """Which of the classes ``rest`` agree with class i on ``MATCHES`` coordinates or more: counted in blocks of coordinates, and
    what cannot reach the threshold with those that are left is skipped."""
    import numpy as np

    at, count = np.arange(len(rest)), np.zeros(len(rest), np.int64)
    for c in range(0, COORDS, SKIP):
        count = count[at] if c else count
        rest = rest[at] if c else rest
        count = count + (sk[rest, c : c + SKIP] == sk[i, c : c + SKIP]).sum(axis=1)
        at = np.flatnonzero(count >= MATCHES - (COORDS - c - SKIP))
    return rest[at]


def forest(sk, n, ids, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of collisions, breadth first: each class in turn takes those of the rest that collide with it."""
    import numpy as np

    left, queue, out = np.ones(len(n), bool), [], []
    for first in range(len(n)):
        if not left[first]:
            continue
        left[first] = False
        queue.append(first)
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return out
            hit = colliding(sk, rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])], i)
            out += [(int(ids[i]), int(ids[j])) for j in hit]
            left[hit] = False
            queue += hit.tolist()
    return out


def _collide(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the collisions inside each posting list (key, id, n, sketch)."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, "key"):
            key, ids, n = (t.column(x).to_numpy() for x in ("key", "id", "n"))
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.concatenate((starts[1:], [len(key)]))
            two = starts[ends - starts == 2]
            two = two[((sk[two] == sk[two + 1]).sum(axis=1) >= MATCHES) & (100 * n[two] >= percent * n[two + 1])]
            pairs = list(zip(ids[two].tolist(), ids[two + 1].tolist(), strict=True))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                if hi - lo > 2:
                    pairs += forest(sk[lo:hi], n[lo:hi], ids[lo:hi], percent)
            pairs = sorted({(min(p), max(p)) for p in pairs})
            yield pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return lists.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(count, "a long, b long")


def confirmed(sets: list, sk, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets, as pairs of their places; sk: their sketches.

    The set with most open collisions is compared with all of them at once; a collision closes when compared, or
    when both its ends are in one component.
    """
    import numpy as np

    g, n = len(sets), np.array([len(s) for s in sets])
    if g == 2:
        at = np.minimum(np.searchsorted(sets[1], sets[0]), n[1] - 1)
        both = int((sets[1][at] == sets[0]).sum())
        return [(0, 1)] if 100 * both >= percent * (n[0] + n[1] - both) else []
    open_ = np.zeros((g, g), bool)
    step = max(1, 4_000_000 // (COORDS * g))
    for at in range(0, g, step):
        open_[at : at + step] = (sk[at : at + step, None, :] == sk[None, :, :]).sum(axis=2) >= MATCHES
    open_ &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    np.fill_diagonal(open_, False)
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)[:-1]))
    label, out, degree = np.arange(g), [], open_.sum(axis=1)
    while True:
        i = int(degree.argmax())
        if not degree[i]:
            return out
        js = np.flatnonzero(open_[i])
        if 4 * len(js) > g:
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            both = np.add.reduceat(sets[i][at] == flat, starts, dtype=np.int64)[js]
        else:
            some = np.concatenate([sets[j] for j in js])
            at = np.minimum(np.searchsorted(sets[i], some), n[i] - 1)
            both = np.add.reduceat(sets[i][at] == some, np.concatenate(([0], np.cumsum(n[js])[:-1])), dtype=np.int64)
        open_[i, js] = open_[js, i] = False
        degree[i] = 0
        degree[js] -= 1
        fresh = js[100 * both >= percent * (n[i] + n[js] - both)]
        merged = False
        for j in fresh.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
                merged = True
        if merged:
            m = np.flatnonzero(label == label[i])
            closed = open_[np.ix_(m, m)]
            degree[m] -= closed.sum(axis=1)
            open_[np.ix_(m, m)] = False


def _confirm(members: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int, classes: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside each group of members (component, id, n, sketch, doc_id, digest, set_hash), of which
    there are at most so many as classes."""
    members = scratch.put(members, "members")
    # Texts are read where they lie: a filter of those that stand for a class lets these through, and only their sets are moved.
    sent = docs.sparkSession.sparkContext.broadcast(build_filter(members.select(F.xxhash64("doc_id", "digest").alias("key"))))
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), _digest(text)).alias("key"))

    def hashed(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in sliced(batches, 4096):
            batch = batch.filter(pa.array(sent.value.test(batch.column("key").to_numpy())))
            for part in sliced([batch], 128):
                sets = [_shingles(x, k, memo) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_hash", "shingles"])

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, "key", 256):
            key, ids = (t.column(x).to_numpy() for x in ("key", "id"))
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in t.column("shingles").chunks for x in chunk]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, b = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                for i, j in confirmed(sets[lo:hi], sk[lo:hi], percent) if hi - lo > 1 else ():
                    a.append(ids[lo + i])
                    b.append(ids[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 128):
            ok = []
            for x, y in zip(batch.column("shingles"), batch.column("pivot_set"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("pivot").filter(keep)], names=["a", "b"])

    sets = rows.mapInArrow(hashed, "set_hash binary, shingles binary").dropDuplicates(["set_hash"])
    sets = sets.join(wide(members.select("set_hash", "id"), classes), "set_hash").select("id", "shingles")
    members = members.select("component", "id", "n", "sketch")
    blocks_of = lambda count, n: F.greatest(F.ceil(count / BLOCK), F.ceil(n * 8 / BLOCK_BYTES)).cast("long")
    sizes = scratch.put(members.groupBy("component").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")), "sizes")
    huge = sizes.where(F.col("blocks") > HUGE).select("component")
    stars = None
    members = members.withColumn("core", F.lit(False))
    if huge.limit(1).count():
        # Most of a huge group links with a few of its own: what these stars join is one component already, and is only
        # compared with the rest.
        sets = scratch.put(sets, "sets")
        own = members.join(huge, "component", "left_semi")
        picked = own.groupBy("component").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(PIVOTS)])).alias("p")).select("component", F.explode("p").alias("pivot"))
        pivots = scratch.put(picked.join(sets.withColumnRenamed("id", "pivot"), "pivot").select("component", "pivot", F.col("shingles").alias("pivot_set")), "pivots")
        tried = wide(own.select("component", "id"), classes).join(sets, "id").join(pivots, "component").select("id", "shingles", "pivot", "pivot_set")
        stars = scratch.put(tried.mapInArrow(linked, "a long, b long").where("a <> b"), "stars")
        star = wide(components(stars, scratch).withColumnRenamed("component", "star"), classes)
        counted = own.join(star, "id").groupBy("component", "star").agg(F.count("*").alias("k")).groupBy("component").agg(F.max_by("star", "k").alias("main"))
        members = members.drop("core").join(star, "id", "left").join(counted, "component", "left").withColumn("core", F.coalesce(F.col("star") == F.col("main"), F.lit(False))).drop("star", "main")
        members = scratch.put(members, "members")
    parts_of = members.groupBy("component").agg(F.coalesce(blocks_of(F.count_if("core"), F.sum(F.when(F.col("core"), F.col("n")))), F.lit(0)).alias("cores"), F.coalesce(blocks_of(F.count_if(~F.col("core")), F.sum(F.when(~F.col("core"), F.col("n")))), F.lit(0)).alias("rests"))
    # A row for each group: few are sent to where the members lie, so that those of one group stay apart.
    groups = sizes.count()
    parts_of = F.broadcast(parts_of) if groups <= WIDE_ROWS else wide(parts_of, groups)
    one = F.lit(1).cast("long")
    block = F.when(F.col("core"), F.pmod(F.xxhash64("id"), F.greatest("cores", one))).otherwise(F.col("cores") + F.pmod(F.xxhash64("id"), F.greatest("rests", one)))
    first, last = F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0).cast("long")), F.col("cores") + F.col("rests") - 1
    dealt = members.join(parts_of, "component").withColumn("block", block).withColumn("other", F.explode(F.when(first <= last, F.sequence(first, last))))
    # Two blocks at a time; a block alone only where there is no other.
    dealt = dealt.where((F.col("cores") + F.col("rests") == 1) | (F.col("block") != F.col("other"))).select("id", "sketch", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    parts = dealt.hint("merge").join(sets, "id").repartition("key").sortWithinPartitions("key", "id").select("key", "id", "sketch", "shingles")
    links = parts.mapInArrow(work, "a long, b long")
    return scratch.put(links if stars is None else links.unionByName(stars), "links")


def _tokens(reps: DataFrame, low) -> DataFrame:
    """(id, c, key) of each coordinate in low."""
    return reps.select("id", F.posexplode(low).alias("c", "v")).select("id", "c", F.xxhash64("c", "v").alias("key"))


def _rarer(reps: DataFrame, live: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, size): live(key, id, size) where classes with keys of over ``LONGEST`` classes post rarer ones in their place.

    All classes order their coordinates in the same way: those that are not frequent by place, then the frequent ones, the
    rarest first. Two that agree on ``MATCHES`` still agree on one of the first ``PREFIX`` of each. A class without a frequent
    key among its first keeps them, and what others post from later places it does not need.
    """
    from pyspark.sql import Window

    common = live.where(F.col("size") > LONGEST)
    held = scratch.put(_tokens(reps.join(common.select("id").distinct().hint("merge"), "id", "left_semi"), F.col("low")), "held")
    later = held.where(F.col("c") >= PREFIX).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > LONGEST)
    frequent = scratch.put(common.select("key", "size").distinct().unionByName(later), "frequent")
    order = Window.partitionBy("id").orderBy(F.col("size").asc_nulls_first(), "c")
    first = held.join(frequent, "key", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= PREFIX)
    more = scratch.put(first.where((F.col("c") >= PREFIX) | F.col("size").isNotNull()).select("key", "id"), "more").hint("merge")
    sizes = more.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return live.where(F.col("size") <= LONGEST).unionByName(more.join(sizes, "key").select("key", "id", "size"))


def _blocks(lists: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (key, id, n, sketch) of any length as lists for pairs of blocks, and collisions (a, b) with pivots.

    Classes that collide with the pivot which most collide with are connected by it: they form the core of the list, whose
    blocks meet the rest only. Sets of sizes too far apart for a link lie in bands that are not neighbours and do not meet.
    """

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            n, m = (batch.column(x).to_numpy() for x in ("n", "pivot_n"))
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            sk, pivot = (batch.column(x).to_pylist() for x in ("sketch", "pivot_sketch"))
            for at in range(0, len(n), WINDOW):
                x, y = (np.frombuffer(b"".join(z[at : at + WINDOW]), np.uint8).reshape(-1, COORDS) for z in (sk, pivot))
                ok[at : at + WINDOW] &= (x == y).sum(axis=1) >= MATCHES
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("key", "id", "pivot")], names=["key", "id", "pivot"])

    one = F.struct(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    picked = lists.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(one, F.xxhash64("id", F.lit(i))) for i in range(PIVOTS)])).alias("p"))
    tried = lists.join(picked, "key").select("key", "id", "n", "sketch", F.explode("p").alias("p")).select("key", "id", "n", "sketch", "p.*")
    stars = scratch.put(tried.mapInArrow(near, "key long, id long, pivot long"), "pivots")
    best = stars.groupBy("key", "pivot").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("pivot"))
    core = stars.join(best, ["key", "pivot"], "left_semi").select("key", "id", F.lit(True).alias("core")).hint("merge")
    # A little wider than the sizes of a link can differ, so rounding parts no pair.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) + 1e-6)).cast("long")
    rows = scratch.put(lists.join(core, ["key", "id"], "left").withColumn("core", F.coalesce("core", F.lit(False))).withColumn("band", band), "long")
    sizes = scratch.put(rows.groupBy("key", "core", "band").agg(F.ceil(F.count("*") / max(1, LONGEST // 2)).cast("long").alias("blocks")), "sizes")
    other = sizes.select(F.col("key").alias("k"), F.struct(F.col("core").alias("core"), F.col("band").alias("band"), F.col("blocks").alias("blocks")).alias("o"))
    meets = (F.col("key") == F.col("k")) & (F.abs(F.col("band") - F.col("o.band")) <= 1) & ~(F.col("core") & F.col("o.core"))
    code = lambda core, band, block: F.xxhash64(core, band, block)
    all_ = F.flatten(F.transform("os", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["blocks"] - 1), lambda r: code(o["core"], o["band"], r))))
    plan = sizes.join(other, meets).groupBy("key", "core", "band", "blocks").agg(F.collect_list("o").alias("os")).select("key", "core", "band", "blocks", all_.alias("all"))
    dealt = rows.join(plan, ["key", "core", "band"]).withColumn("own", code(F.col("core"), F.col("band"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    # Two blocks at a time; a block alone only where there is no other.
    others = F.array_remove("all", F.col("own"))
    dealt = dealt.select("key", "id", "n", "sketch", "own", F.explode(F.when(F.size(others) > 0, others).otherwise(F.array("own"))).alias("other"))
    pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "n", "sketch")
    return pairs, stars.select(F.col("id").alias("a"), F.col("pivot").alias("b")).where("a <> b")


def _grouped(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, n_shingles, component, least) for each row of docs: a number that linked texts share and the least doc_id among
    them, both null for an empty set. What counts is the text: rows that repeat an id, and rows without one, are like any others."""
    signed = scratch.put(signatures(docs, k).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = signed.where("set_hash is not null")
    alike = [F.first(c).alias(c) for c in ("n_shingles", "low", "sketch")]
    told = some.groupBy("set_hash").agg(F.min(F.struct("row", "doc_id", "digest")).alias("r"), F.min("doc_id").alias("least"), *alike)
    reps = scratch.put(told.select(F.col("r.row").alias("id"), "r.doc_id", "r.digest", "set_hash", "least", F.col("n_shingles").alias("n"), "low", "sketch"), "classes")

    # Spark sizes postings by one coordinate of each class, and would send them all to the driver and on.
    n = reps.count()
    posted = wide(_tokens(reps, F.slice("low", 1, PREFIX)).select("id", "key"), n * PREFIX)
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    live = wide(scratch.put(posted.join(lists, "key"), "postings"), n * PREFIX)
    sketches = wide(reps.select("id", "n", "sketch"), n)
    met = None
    if live.where(F.col("size") > LONGEST).limit(1).count():
        live = wide(scratch.put(_rarer(reps, live, scratch), "postings"), n * PREFIX)
        long_ = live.where(F.col("size") > LONGEST)
        if long_.limit(1).count():
            dealt, met = _blocks(scratch.put(long_.select("key", "id").join(sketches, "id"), "long"), scratch, percent)
            met = met.unionByName(_collide(dealt, percent))
        live = live.where(F.col("size") <= LONGEST)

    short = _collide(live.select("key", "id").join(sketches, "id"), percent)
    met = short if met is None else met.unionByName(short)
    groups = components(met, scratch)
    links = _confirm(groups.join(wide(reps, n).select("id", "n", "sketch", "doc_id", "digest", "set_hash"), "id"), docs, scratch, k, percent, n)
    comps = components(links, scratch).withColumnRenamed("id", "rep")
    classes = scratch.put(wide(reps, n).select("id", "set_hash", "least").join(comps, F.col("id") == F.col("rep"), "left").select("set_hash", "least", "component", "id"), "linked")
    leasts = scratch.put(classes.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("least").alias("l")), "leasts")
    # A class without links is looked up by its own number, which no component has, so that not all of them are dealt to one task.
    placed = classes.withColumn("component", F.coalesce("component", "id")).join(wide(leasts, n), F.col("component") == F.col("c"), "left")
    placed = placed.select(F.col("set_hash").alias("h"), "component", F.when(F.col("c").isNotNull(), F.col("l")).otherwise(F.col("least")).alias("least"))
    placed = scratch.put(placed, "placed")
    scratch.keep(signed, placed)
    placed = wide(placed, n)
    return signed.join(placed, signed["set_hash"] == placed["h"], "left").select("doc_id", "digest", "n_shingles", "component", "least")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    A document's set holds its distinct k-word shingles (lower-cased A-Z; the whole sequence where it is shorter).
    Documents link where 100 * intersection >= percent * union; component_id is the smallest doc_id that can be reached,
    kept marks it. Null, empty and wordless texts have no set, link with nothing and are kept. Rows that repeat a
    doc_id are returned each, by their own texts. A row without id links like others; it is kept only where no linked row has an
    id. An empty table gives an empty result; further columns are ignored.
    """
    rows = _grouped(docs, k, percent, Scratch(docs.sparkSession))
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, of linked texts one: that with the smallest doc_id (none comes last), of equal ids the first by digest of its
    text, of rows equal in both any one. Texts without words all stay. All columns are kept, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    rows = _grouped(docs, k, percent, scratch).where("component is not null")
    pair = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    told = scratch.put(rows.groupBy("doc_id", "digest").agg(F.min("component").alias("component"), F.count("*").alias("times")), "texts")
    first = scratch.put(told.groupBy(F.col("component").alias("c")).agg(F.min(pair).alias("first")), "first")
    stays = told.join(wide(first, told.count()), told["component"] == first["c"]).select("doc_id", "digest", "times", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays"))
    stays = scratch.put(stays.select(F.struct("doc_id", "digest").alias("key"), "times", "stays"), "stays")
    scratch.keep(stays)
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc = doc.withColumn("id", F.col("doc.doc_id").cast("long")).withColumn("digest", _digest(F.col("doc.text").cast("string")))
    met = doc.join(stays, doc["id"].eqNullSafe(F.col("key.doc_id")) & doc["digest"].eqNullSafe(F.col("key.digest")), "left").where("coalesce(stays, true)")
    once = met.where("coalesce(times, 1) = 1").select("doc")
    again = met.where("times > 1").dropDuplicates(["id", "digest"]).select("doc")
    return once.unionByName(again).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
