"""Exact top-k by integer inner product with a pivot table.

Distances of every vector to many pivots are computed once. For a query q and a candidate v each pivot p gives
|d(q, p) - d(v, p)| <= d(q, v), so the largest of these is a lower bound L of the distance, and
(|q|^2 + |v|^2 - L^2) / 2 is an upper bound of the inner product. Candidates are evaluated in the order of their
bounds until the k-th best score found exceeds every bound that is left; ties of scores are still evaluated.

1. Vectors are dealt into chunks of bounded size, those of a chunk nearest to the same pivot; so are queries, into blocks, unless
   they are so few that some pivots share one: each block costs a copy of the chunks it needs.
2. Each query is answered within its own chunk first: its k-th score there is a floor.
3. Ranges of distances of a block and a chunk bound all their inner products at once: where that lies below the floors of the block,
   the chunk is never sent to it. Otherwise a task holds one block and one chunk, skips what lies below a query's floor, and keeps k rows
   for each query. A last step merges these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import Scratch, sliced

SCALE, PIVOTS = 1024, 48
#: Vectors in a chunk and queries in a block at most; candidates evaluated at once.
CHUNK, QUERIES, STEP = 65_536, 16_384, 256
#: Chunks whose ranges are broadcast (40 MB of numbers); of more, none is left out beforehand.
RANGES = 100_000


def scaled(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of each component; vectors with null or non-finite components or none are left out."""
    big = 2.0**62 / SCALE
    x = F.col(column).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(big))), F.lit(False)) & (F.size(x) > 0)
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where("fine")
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _pivoted(rows: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """(vec_id, v, dim, far, cell): components and distances to the pivots of the same length, as bytes; cell: the nearest pivot."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        by = {}
        for p in pivots:
            by.setdefault(len(p), []).append(p)
        by = {d: np.array(p, np.float64) for d, p in by.items()}
        for batch in sliced(batches, 4096):
            v, dim, far, cell = [], [], [], []
            for row in batch.column("v").to_pylist():
                a = np.array(row, np.int64)
                p = by.get(len(a))
                apart = np.empty(0) if p is None else np.sqrt(((p - a) ** 2).sum(axis=1))
                v.append((a.astype(np.int32) if np.abs(a).max() < 2**31 else a).tobytes())
                dim.append(len(a))
                far.append(apart.astype(np.float32).tobytes())
                cell.append(int(apart.argmin()) if len(apart) else 0)
            made = [pa.array(v, pa.binary()), pa.array(dim, pa.int32()), pa.array(far, pa.binary()), pa.array(cell, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made], names=["vec_id", "v", "dim", "far", "cell"])

    return rows.mapInArrow(work, "vec_id long, v binary, dim int, far binary, cell int")


def _numbers(raw: list[bytes], dim: int):
    """Rows of integers from bytes of either width."""
    import numpy as np

    if all(len(x) == 4 * dim for x in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(x, np.int32 if len(x) == 4 * dim else np.int64) for x in raw], np.int64).reshape(-1, dim)


def slack(norms):
    """What rounding may take from a bound: distances are kept in single precision."""
    return 1e-6 * norms + 1


def best_of(q, q_far, v, v_far, ids, own, k, floor=None, vv=None):
    """The k best (score, id) of candidates v for query q, and how many were evaluated; none below ``floor``."""
    import numpy as np

    qq, vv = float((q.astype(np.float64) ** 2).sum()), (v.astype(np.float64) ** 2).sum(axis=1) if vv is None else vv
    low = np.abs(v_far.astype(np.float64) - q_far).max(axis=1) if v_far.shape[1] else np.zeros(len(v))
    upper = (qq + vv - low * low) / 2 + slack(qq + vv)
    upper[ids == own] = -np.inf
    left = np.flatnonzero(upper >= (-1e300 if floor is None else floor))
    score, found, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
    order = left[np.argsort(-upper[left], kind="stable")]
    exact = float(max(qq, vv.max(initial=0.0))) < 2.0**52
    for at in range(0, len(order), STEP):
        if len(score) >= k and score[k - 1] > upper[order[at]]:
            break
        part = order[at : at + STEP]
        if exact:
            fresh = (v[part].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        else:
            fresh = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in v[part].astype(object) @ q.astype(object)], np.int64)
        score, found = np.concatenate([score, fresh]), np.concatenate([found, ids[part]])
        keep = np.lexsort((found, -score))[:k]
        score, found = score[keep], found[keep]
        done += len(part)
    return score, found, done


def _ranges(rows: DataFrame, group: str, floored: bool) -> DataFrame:
    """(group, dim, lo, hi, norm, floor): least and greatest distance to each pivot, greatest squared length and least floor of a group."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([(group, pa.int64()), ("dim", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary()), ("norm", pa.float64()), ("floor", pa.float64())])
        told: dict = {}
        for batch in sliced(batches, 4096):
            floors = batch.column("floor").to_pylist() if floored else [0.0] * batch.num_rows
            for g, d, v, far, floor in zip(*(batch.column(c).to_pylist() for c in (group, "dim", "v", "far")), floors, strict=True):
                far, norm = np.frombuffer(far, np.float32), float((_numbers([v], d)[0].astype(np.float64) ** 2).sum())
                floor = -1e300 if floor is None else float(floor)
                was = told.get((g, d))
                told[g, d] = (far, far, norm, floor) if was is None else (np.minimum(was[0], far), np.maximum(was[1], far), max(was[2], norm), min(was[3], floor))
        rows = [(g, d, lo.tobytes(), hi.tobytes(), norm, floor) for (g, d), (lo, hi, norm, floor) in told.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def merge(t):
        import numpy as np
        import pyarrow as pa

        lo, hi = (np.array([np.frombuffer(x, np.float32) for x in t.column(c).to_pylist()]) for c in ("lo", "hi"))
        norm, floor = max(t.column("norm").to_pylist()), min(t.column("floor").to_pylist())
        return pa.table({group: t.column(group).slice(0, 1), "dim": t.column("dim").slice(0, 1), "lo": pa.array([lo.min(axis=0).tobytes()], pa.binary()), "hi": pa.array([hi.max(axis=0).tobytes()], pa.binary()), "norm": [norm], "floor": [floor]})

    schema = f"{group} long, dim int, lo binary, hi binary, norm double, floor double"
    return rows.mapInArrow(work, schema).groupBy(group, "dim").applyInArrow(merge, schema)


def _dealt(rows: DataFrame, name: str, most: int, fewest: int, scratch: Scratch) -> DataFrame:
    """rows with a number ``name``: groups of at most about ``most`` rows, of the same length and nearest pivot where there are as many
    groups as pivots."""
    n = rows.count()
    if -(-n // most) < fewest:
        return scratch.put(rows.withColumn(name, F.pmod("cell", F.lit(max(1, -(-n // most)))).cast("long")), name)
    size = most
    cells = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    cells = cells.select(F.col("dim").alias("d"), F.col("cell").alias("c"), "parts")
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    met = rows.join(F.broadcast(cells), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    return scratch.put(met.withColumn(name, F.xxhash64("dim", "cell", part)).drop("d", "c", "parts"), name)


def _search(k: int, own_chunk: bool):
    """Compares the queries of a group with its vectors; with ``own_chunk`` those that live in the chunk, else all others."""

    def work(a, b):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "vec_id": [], "score": [], "evaluated": []}
        chunk = b.column("chunk")[0].as_py() if b.num_rows else None
        for d in set(a.column("dim").to_pylist()):
            mine, theirs = (t.filter(pa.array(t.column("dim").to_numpy() == d)) for t in (a, b))
            if not theirs.num_rows:
                continue
            v = _numbers(theirs.column("v").to_pylist(), d)
            vv = (v.astype(np.float64) ** 2).sum(axis=1)
            far = np.frombuffer(b"".join(theirs.column("far").to_pylist()), np.float32).reshape(len(v), -1)
            ids = theirs.column("vec_id").to_numpy()
            for own, q, f, floor, home in zip(*(mine.column(c).to_pylist() for c in ("vec_id", "v", "far", "floor", "home")), strict=True):
                if (home == chunk) != own_chunk:
                    continue
                score, found, done = best_of(_numbers([q], d)[0], np.frombuffer(f, np.float32), v, far, ids, own, k, floor, vv)
                # A query that finds nothing still says what it cost.
                out["query_id"] += [own] * max(1, len(score))
                out["vec_id"] += found.tolist() or [None]
                out["score"] += score.tolist() or [None]
                out["evaluated"] += [done] + [0] * (max(1, len(score)) - 1)
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return work


def top_k(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 100, k: int = 10, evaluated: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, the smaller vec_id first on ties.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own id, of the same
    length. Fewer rows come back where there are fewer candidates. Rows with a null id, no components, or null,
    non-finite or huge (|x| >= 2**52) components take no part; a score beyond 64 bits is cut to their range. Rows that repeat a query's
    id are one query, by the first by value; repeated candidates count each. An empty table gives an empty result; further columns are
    ignored. With ``evaluated`` a last column says how many candidates of the query were compared component by component.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scaled(vectors, id_column, column)
    # As many pivots as a parameter says, whatever the size of the table.
    pivots = [r["v"] for r in rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()]
    table = _dealt(scratch.put(_pivoted(rows, pivots), "pivots"), "chunk", CHUNK, 0, scratch)
    one = F.min(F.struct("v", "dim", "far", "cell", F.col("chunk").alias("home"))).alias("q")
    asked = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(one).select("vec_id", "q.*")
    queries = _dealt(scratch.put(asked, "asked"), "block", QUERIES, PIVOTS, scratch)

    schema = "query_id long, vec_id long, score long, evaluated long"
    at_home = queries.withColumn("chunk", F.col("home")).withColumn("floor", F.lit(None).cast("long"))
    seeds = scratch.put(at_home.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(_search(k, True), schema), "seeds")
    floors = scratch.put(seeds.where("score is not null").groupBy(F.col("query_id").alias("q")).agg(F.min("score").alias("least"), F.count("*").alias("n")), "floors")
    queries = queries.join(floors, F.col("vec_id") == F.col("q"), "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least"))).drop("q", "least", "n")
    queries = scratch.put(queries, "queries")

    wanted = scratch.put(_wanted(_ranges(queries, "block", True), scratch.put(_ranges(table, "chunk", False), "ranges")), "wanted")
    left = queries.join(wanted.select("block", F.col("chunk")).distinct(), "block")
    right = table.join(wanted.select("chunk", "block").distinct(), "chunk")
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_search(k, False), schema)
    found = seeds.unionByName(found)
    if evaluated:
        found = scratch.put(found, "found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if evaluated:
        out = out.join(found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated")), "query_id")
    return out


def _wanted(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(block, chunk) of which some inner product may reach a floor of the block."""
    if chunks.count() > RANGES:
        return blocks.select("block", "dim").join(chunks.select("chunk", "dim"), "dim").select("block", "chunk")
    told = chunks.toArrow()

    def work(batches):
        import numpy as np
        import pyarrow as pa

        ids, dims, norm = (told.column(c).to_numpy() for c in ("chunk", "dim", "norm"))
        lo, hi = (told.column(c).to_pylist() for c in ("lo", "hi"))
        for batch in sliced(batches, 64):
            out_b, out_c = [], []
            for b, d, q_lo, q_hi, q_norm, floor in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "lo", "hi", "norm", "floor")), strict=True):
                at = np.flatnonzero(dims == d)
                v_lo, v_hi = (np.frombuffer(b"".join(x[i] for i in at), np.float32).reshape(len(at), -1).astype(np.float64) for x in (lo, hi))
                q_lo, q_hi = np.frombuffer(q_lo, np.float32).astype(np.float64), np.frombuffer(q_hi, np.float32).astype(np.float64)
                gap = np.maximum(0, np.maximum(q_lo - v_hi, v_lo - q_hi)).max(axis=1, initial=0.0)
                upper = (q_norm + norm[at] - gap * gap) / 2 + slack(q_norm + norm[at])
                keep = ids[at[upper >= floor]]
                out_b += [b] * len(keep)
                out_c += keep.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_c, pa.int64())], names=["block", "chunk"])

    return blocks.mapInArrow(work, "block long, chunk long")


#: The same for DuckDB.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and list_aggregate(list_transform(embedding, lambda x: case when isfinite(x) then 0 else 1 end), 'sum') = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
