"""Near duplicates of embeddings by sorted projection passes.

1. Equal vectors are one class at once, whatever their number.
2. In each pass the classes are ordered by 64 random hashes of the vector, concatenated, and each is compared with its next
   ``WINDOW`` neighbours. A hash says which of two vectors of the table, drawn at random, is nearer: in a table without clusters that is
   the sign of a random projection, and a cluster is cut by the pairs that lie in it. The order is dealt out by range; the ends of
   neighbouring ranges are compared in a step of their own. Ranges shorter than a window are compared there as a whole, together with
   all that follow up to one that is not, and empty ones are passed over, so no neighbour is lost at a border.
3. Rows of an order carry directions in 16 bits a component. That bounds the error of a cosine; pairs surely above the threshold are
   links, the few within the error are compared in double precision afterwards. Links of all passes are united into components.
4. A window is a bound on partners, so the rest is found exactly: inside each component all its classes are compared,
   in blocks, and only their numbers of links leave a task. In a large component the vectors near its mean direction
   are linked by the triangle inequality of angles and only counted, so a huge group of near copies is not squared.

Two vectors of angle a agree on one hash with chance 1 - a / pi, and share a window once they agree on log2(classes / ``WINDOW``)
hashes; `passes_for` takes as many passes as find a pair at the threshold with chance ``RECALL``, so their number grows with the table.
A pair that no pass brings together is found only if other links join the two.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlens.llm.common import Scratch, runs, sliced
from archlens.llm.components import components

WINDOW, BITS, RECALL, FEWEST = 256, 64, 0.99, 4
#: Vectors of the table that hashes are drawn from.
DRAWN = 2048
#: Classes of a component in a block; a task compares two blocks.
BLOCK = 1024


def passes_for(classes: int, cosine: float, window: int | None = None) -> int:
    """Passes after which a pair at the threshold has shared a window with chance ``RECALL``."""
    window = window or WINDOW
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    met = max(1e-3, agree) ** max(0.0, math.log2(max(1, classes) / window))
    return FEWEST if met >= 1 else max(FEWEST, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def prepared(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, str]:
    """(id, same, vector): components as bytes, -0.0 as 0.0, and a digest that equal vectors share; nulls for what takes no part.

    Also the type of the components: that of the table, so no precision is lost and none is made up.
    """
    element = getattr(vectors.schema[column].dataType, "elementType", T.DoubleType())
    kind, cast = ("<f4", "array<float>") if isinstance(element, T.FloatType) else ("<f8", "array<double>")

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in sliced(batches, 4096):
            v = batch.column("v")
            flat, at = pc.fill_null(v.values, float("nan")).to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            same, raw = [None] * len(v), [None] * len(v)
            for i, there in enumerate(v.is_valid().to_pylist()):
                a = flat[at[i] : at[i + 1]] + 0 if there else flat[:0]
                if len(a) and np.isfinite(a).all() and a.any():
                    raw[i] = a.astype(kind).tobytes()
                    same[i] = hashlib.md5(raw[i]).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], names=["id", "same", "vector"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(cast).alias("v"))
    return rows.mapInArrow(work, "id long, same binary, vector binary"), kind


def units(raw: list[bytes], kind: str):
    """Unit vectors in double precision of components of one length."""
    import numpy as np

    m = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _planes(drawn: list[bytes], kind: str, passes: int, seed: int) -> dict:
    """By number of components: directions whose signs are the hashes of all passes."""
    import numpy as np

    by: dict = {}
    for v in drawn:
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, raw in by.items():
        rng = np.random.default_rng(seed + size)
        m = units(sorted(raw), kind)
        a, b = rng.integers(0, len(m), (2, passes * BITS))
        plane = (m[a] - m[b]).T
        empty = ~plane.any(axis=0)
        plane[:, empty] = rng.standard_normal((m.shape[1], int(empty.sum())))
        out[size] = plane
    return out


def _keys(classes: DataFrame, kind: str, passes: int, seed: int) -> DataFrame:
    """A row (pass, key, id, way) for each pass; way: the direction in 16 bits a component."""
    drawn = [r["vector"] for r in classes.select("vector", "id").orderBy(F.xxhash64("id"), "id").limit(DRAWN).collect()]
    planes = _planes([bytes(v) for v in drawn], kind, passes, seed)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 1024):
            ids, vectors = batch.column("id").to_numpy(), batch.column("vector").to_pylist()
            by: dict = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for size, at in by.items():
                m = units([vectors[i] for i in at], kind)
                if size not in planes:  # no vector of that length was drawn
                    planes[size] = np.random.default_rng(seed + size).standard_normal((m.shape[1], passes * BITS))
                keys = np.packbits((m @ planes[size] > 0).reshape(len(at), passes, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                ways = np.rint(m * (32767 / np.abs(m).max(axis=1, keepdims=True))).astype("<i2")
                ways = pa.array([w.tobytes() for w in ways], pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(keys[:, p].view(np.int64)), pa.array(ids[at]), ways], names=["pass", "key", "id", "way"])

    return classes.select("id", "vector").mapInArrow(work, "pass int, key long, id long, way binary")


def joined_labels(n: int, a, b):
    """For each of n places the smallest that pairs (a, b) join it with."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(fresh, x, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    return label


def _linked(pass_, ids, ways: list[bytes], cosine: float, window: int, first: int = 0):
    """(a, b, sure) of neighbours within the window, of which one stands at ``first`` or later: for what is surely linked a tree on the
    first of each group, and pairs that error leaves open between groups."""
    import numpy as np

    none = np.empty(0, np.int64)
    n = len(ids)
    if n < 2:
        return none, none, np.empty(0, bool)
    sizes = np.array([len(v) for v in ways])
    d = int(sizes.max())
    m = np.frombuffer(b"".join(v if len(v) == d else v.ljust(d, b"\x00") for v in ways), "<i2").reshape(n, -1).astype(np.float32)
    m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    # Each component is off by half a unit in 32,767 at most, the largest being that long; and float32 rounds.
    error = 1.1 * math.sqrt(m.shape[1]) / 32767 + 1e-5
    found: list = [[], [], [], []]
    for lo in range(max(0, first - window) if first else 0, n, window):
        c = m[lo : lo + window] @ m[lo : lo + 2 * window].T
        i, j = np.nonzero(c >= cosine - error)
        ok = (j > i) & (j - i <= window) & (lo + j >= first)
        i, j = i[ok], j[ok]
        sure = c[i, j] >= cosine + error
        i, j = i + lo, j + lo
        fits = (pass_[i] == pass_[j]) & (sizes[i] == sizes[j])
        for out, x in zip(found, (i[fits & sure], j[fits & sure], i[fits & ~sure], j[fits & ~sure]), strict=True):
            out.append(x)
    i, j, x, y = (np.concatenate([*v, none]).astype(np.int64) for v in found)
    label = joined_labels(n, i, j)
    tree = np.flatnonzero(label != np.arange(n))
    open_ = label[x] != label[y]
    a, b = np.concatenate([ids[label[tree]], ids[x[open_]]]), np.concatenate([ids[tree], ids[y[open_]]])
    return np.minimum(a, b), np.maximum(a, b), np.arange(len(a)) < len(tree)


def window_links(classes: DataFrame, kind: str, cosine: float, passes: int, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Pairs (a, b) that join the classes which have met in a window of some pass with a cosine high enough."""
    ordered = _keys(classes, kind, passes, seed).repartitionByRange("pass", "key", "id").sortWithinPartitions("pass", "key", "id").withColumn("part", F.spark_partition_id())
    window = WINDOW

    def work(batches):
        import numpy as np
        import pyarrow as pa

        fields = [("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_()), ("part", pa.int32()), ("side", pa.int32()), ("place", pa.int32()), ("pass", pa.int32()), ("id", pa.int64()), ("way", pa.binary())]
        schema = pa.schema(fields)

        def end(t, side, part):
            """The rows at the head (side 0) or the tail (1) of this range, or all of a short one (2), in order."""
            n = t.num_rows
            nulls = [pa.nulls(n, f.type) for f in list(schema)[:3]]
            own = [t.column(c).combine_chunks() for c in ("pass", "id", "way")]
            marks = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
            return pa.RecordBatch.from_arrays([*nulls, *marks, *own], schema=schema)

        tail = head = None
        part = 0
        for batch in sliced(batches, 16 * window):
            t = pa.Table.from_batches([batch])
            part = t.column("part")[0].as_py()
            head = t.slice(0, window) if head is None else head if head.num_rows >= window else pa.concat_tables([head, t]).slice(0, window)
            fresh = 0 if tail is None else tail.num_rows
            t = t if tail is None else pa.concat_tables([tail, t])
            a, b, sure = _linked(t.column("pass").to_numpy(), t.column("id").to_numpy(), t.column("way").to_pylist(), cosine, window, fresh)
            rest = [pa.nulls(len(a), f.type) for f in list(schema)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure), *rest], schema=schema)
            tail = t.slice(max(0, t.num_rows - window))
        if head is not None and head.num_rows < window:
            yield end(head, 2, part)
        elif head is not None:
            yield end(head, 0, part)
            yield end(tail, 1, part)

    def across(group):
        import pyarrow as pa

        group = group.sort_by([("part", "ascending"), ("place", "ascending")])
        a, b, sure = _linked(group.column("pass").to_numpy(), group.column("id").to_numpy(), group.column("way").to_pylist(), cosine, window)
        return pa.table({"a": a, "b": b, "sure": sure})

    got = scratch.put(ordered.mapInArrow(work, "a long, b long, sure boolean, part int, side int, place int, pass int, id long, way binary"), "windows")
    rows = got.where("a is null")
    parts = rows.groupBy("part").agg(F.max("side").alias("side")).orderBy("part").collect()  # a row for each range
    if parts:
        groups = classes.sparkSession.createDataFrame(_borders([(r["part"], r["side"] == 2) for r in parts]), "part int, side int, border int")
        rows = rows.join(F.broadcast(groups), ["part", "side"])
    else:
        rows = rows.withColumn("border", F.lit(0))
    border = rows.select("border", "part", "place", "pass", "id", "way").groupBy("border").applyInArrow(across, "a long, b long, sure boolean")
    pairs = scratch.put(got.where("a is not null").select("a", "b", "sure").unionByName(border).groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")
    scratch.drop(got)
    open_ = pairs.where("not sure").select("a", "b")
    ends = lambda side: classes.select(F.col("id").alias(side), F.col("vector").alias(f"v{side}"))
    return pairs.where("sure").select("a", "b").unionByName(open_.join(ends("a"), "a").join(ends("b"), "b").mapInArrow(_confirmed(kind, cosine), "a long, b long"))


def _borders(parts: list[tuple[int, bool]]) -> list[tuple[int, int, int]]:
    """(part, side, border) of ranges (part, short) in order: the border at which a range's head, its tail or all of it is compared. A
    short range has one border for both sides, so that what lies before it also meets what comes after."""
    out, border = [], 0
    for part, short in parts:
        if short:
            out.append((part, 2, border))
        else:
            out += [(part, 0, border), (part, 1, border + 1)]
            border += 1
    return out


def _confirmed(kind: str, cosine: float):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            ok = [float(np.dot(units([x], kind)[0], units([y], kind)[0])) >= cosine for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return work


def _centred(members: DataFrame, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """members with ``core``: in a component of more than a block, whether a vector lies so near to the component's mean direction
    that any two such vectors are surely linked, since angles obey the triangle inequality.
    """
    near = math.cos(math.acos(max(-1.0, min(1.0, cosine))) / 2) + 1e-9

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in sliced(batches, 4096):
            by: dict = {}
            for c, v in zip(batch.column("component").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                by.setdefault(c, []).append(v)
            for c, raw in by.items():
                part = units(raw, kind).sum(axis=0)
                total[c] = total[c] + part if c in total else part
        yield pa.RecordBatch.from_pydict({"component": list(total), "part": [v.tobytes() for v in total.values()]}, schema=pa.schema([("component", pa.int64()), ("part", pa.binary())]))

    def mean(group):
        import numpy as np
        import pyarrow as pa

        m = np.sum([np.frombuffer(x, np.float64) for x in group.column("part").to_pylist()], axis=0)
        m = m / max(float(np.sqrt(m @ m)), 1e-300)
        return pa.table({"c": group.column("component").slice(0, 1), "mean": pa.array([m.tobytes()], pa.binary())})

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            told = zip(batch.column("vector").to_pylist(), batch.column("mean").to_pylist(), strict=True)
            ok = [m is not None and float(units([v], kind)[0] @ np.frombuffer(m, np.float64)) >= near for v, m in told]
            yield batch.drop_columns(["mean"]).append_column("core", pa.array(ok, pa.bool_()))

    large = scratch.put(members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("component"), "large")
    parts = members.join(large, "component", "left_semi").select("component", "vector").mapInArrow(sums, "component long, part binary")
    means = scratch.put(parts.groupBy("component").applyInArrow(mean, "c long, mean binary"), "means")
    told = members.join(means, F.col("component") == F.col("c"), "left").select("component", "id", "copies", "vector", "mean")
    return told.mapInArrow(judge, "component long, id long, copies long, vector binary, core boolean")


def link_counts(members: DataFrame, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, n_links) of members (component, id, copies, vector): copies of other classes of the component that link with id.

    A component is dealt into blocks; each task compares two blocks, so none holds a whole component. Vectors of a component's
    core are all linked with each other: they are counted, and compared with the others only.
    """
    told = scratch.put(_centred(members, kind, cosine, scratch), "members")
    sums = told.groupBy("component").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("held"))
    weights = scratch.put(sums.where("n_core + n_rest > 1"), "weights")
    sized = told.join(weights, "component")
    core_blocks, rest_blocks = F.ceil(F.col("n_core") / BLOCK).cast("long"), F.ceil(F.col("n_rest") / BLOCK).cast("long")
    dealt = sized.withColumn("cores", core_blocks).withColumn("blocks", core_blocks + rest_blocks)
    one = F.lit(1).cast("long")
    rest = F.col("cores") + F.pmod(F.xxhash64("id"), F.greatest(F.col("blocks") - F.col("cores"), one))
    block = F.when(F.col("core"), F.pmod(F.xxhash64("id"), F.greatest("cores", one))).otherwise(rest)
    first = F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0).cast("long"))
    others = F.when(first < F.col("blocks"), F.sequence(first, F.col("blocks") - 1))
    key = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    both = dealt.withColumn("block", block).withColumn("other", F.explode(others)).select(key, "block", "id", "copies", "vector")
    inside = sized.where("core").select("id", (F.col("held") - F.col("copies")).alias("n"))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, "key"):
            key, block, ids, copies = (t.column(x).to_numpy() for x in ("key", "block", "id", "copies"))
            vectors = t.column("vector").to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out_i, out_n = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                m = units(vectors[lo:hi], kind)
                mine = block[lo:hi] == block[lo]
                if mine.all():
                    c = (m @ m.T >= cosine).astype(np.int64)
                    np.fill_diagonal(c, 0)
                    out_i.append(ids[lo:hi])
                    out_n.append(c @ copies[lo:hi])
                else:
                    c = (m[mine] @ m[~mine].T >= cosine).astype(np.int64)
                    out_i += [ids[lo:hi][mine], ids[lo:hi][~mine]]
                    out_n += [c @ copies[lo:hi][~mine], c.T @ copies[lo:hi][mine]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["id", "n"])

    parts = both.repartition("key").sortWithinPartitions("key", "block", "id")
    return parts.mapInArrow(work, "id long, n long").unionByName(inside).groupBy("id").agg(F.sum("n").alias("n_links"))


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    n_links: rows other than its own whose cosine is at least as given, of those in its component; component_id: smallest id that
    links reach. Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    kept; so are rows with a null id, and vectors of different lengths to each other. Equal vectors link with each other.
    Ids are taken to be unique: rows that repeat an id are returned each, by their own vectors. An empty table gives an empty
    result; further columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    made, kind = prepared(vectors, id_column, column)
    rows = scratch.put(made.select("id", "same"), "rows")
    some = made.where("same is not null and id is not null")
    # Vectors of a class are equal. Where an id has several vectors, its classes are told apart by a number of their own.
    grouped = some.groupBy("same").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = scratch.put(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    links = window_links(classes, kind, cosine, passes_for(classes.count(), cosine), scratch)
    comps = scratch.put(components(links, scratch), "components")
    members = scratch.put(classes.join(comps, "id").select("component", "id", "copies", "vector"), "linked")
    counts = scratch.put(link_counts(members, kind, cosine, scratch), "counts")
    named = scratch.put(classes.select("id", "least").join(comps, "id").groupBy(F.col("component").alias("c")).agg(F.min("least").alias("low")), "named")
    told = classes.select("id", "same", "least", "copies").join(comps, "id", "left").join(counts, "id", "left").join(named, F.col("component") == F.col("c"), "left")
    placed = scratch.put(told.select(F.col("same").alias("s"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n"), F.coalesce("low", "least").alias("low")), "placed")
    scratch.keep(rows, placed)
    out = rows.join(placed, (rows["same"] == placed["s"]) & rows["id"].isNotNull(), "left")
    own = F.coalesce(F.col("low"), F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
