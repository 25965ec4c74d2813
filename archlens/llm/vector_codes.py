"""Compression of vectors to codes by a codebook for each part of a vector, in integers throughout.

Components become integers, vectors are cut into equal parts, and each part is written as the index of the nearest entry of its
part's codebook. Codebooks are small (parts x entries x part length numbers, whatever the table) and are broadcast. A round is
one scan: for an Arrow batch all distances come from |x|^2 - 2 x.c + |c|^2, with x.c one integer matrix product for each part;
each task adds up the parts of each entry, and a grouped shuffle merges these sums, one row for each task and entry. No vector
is shuffled, so equal or clustered vectors are no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import Scratch, sliced

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to which the sums of errors are broadcast; more are joined with the rows of a label dealt over SALTS keys.
LABELS, SALTS = 100_000, 64
TOP = 2**63 - 1


def usable(vectors: DataFrame, id_column: str, column: str, label: str) -> DataFrame:
    """(vec_id, label, x): rows whose vector is not null and holds only finite numbers, as doubles."""
    x = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & fine)


def _commonest(rows: DataFrame) -> int | None:
    """The length that most vectors have, the least on ties."""
    met = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return met["n"] if met else None


def integers(x):
    """floor(SCALE * x) of finite doubles, exactly: int64 where that is sure to do for sums and distances too, else Python integers."""
    import math

    import numpy as np

    if not x.size or np.abs(x).max() < 2.0**17:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _parts(batch, width: int):
    """(rows, PARTS, width) integers of a batch; the last part is filled up with zeros."""
    import numpy as np

    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    full = np.zeros((batch.num_rows, PARTS * width))
    full[:, : flat.shape[1]] = flat
    return integers(full).reshape(batch.num_rows, PARTS, width)


def nearest(x, books):
    """(index, squared distance) of the nearest entry for each part of x; the lower index on ties. Exact for all integers.

    64-bit products may wrap on the way, but the distance itself fits where components are below 2**29, and so comes out right.
    """
    import numpy as np

    wide = [np.array(b, object) for b in books]
    big = max([abs(int(c)) for b in wide for c in b.ravel()] + [int(np.abs(x).max()) if x.size else 0])
    kind = np.int64 if x.shape[2] * (2 * big) ** 2 < 2**63 else object
    index, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], kind)
    for p, book in enumerate(wide):
        a, c = x[:, p].astype(kind), book.astype(kind)
        apart = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
        index[:, p] = apart.argmin(axis=1)
        far[:, p] = np.take_along_axis(apart, index[:, p, None], axis=1)[:, 0]
    return index, far


def first_books(rows: DataFrame, width: int, entries: int) -> list:
    """For each part the entries that the vectors of the smallest ids hold there, in the order of ids; repeated ids by their vectors."""
    import numpy as np

    lead = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # as many as a parameter says
    full = np.zeros((len(lead), PARTS * width))
    for row, r in zip(full, lead, strict=True):
        row[: len(r["x"])] = r["x"]
    return list(integers(full).reshape(len(lead), PARTS, width).swapaxes(0, 1))


def _sums(rows: DataFrame, books, width: int) -> DataFrame:
    """(part, entry, n, total): for each task, how many parts each entry got and their sums, as text since they may exceed 64 bits."""

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        told: dict = {}
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            x = _parts(batch, width)
            index, _ = nearest(x, books.value)
            for p in range(PARTS):
                order = np.argsort(index[:, p], kind="stable")
                met, at = np.unique(index[order, p], return_index=True)
                sums = np.add.reduceat(x[order, p], at, axis=0)
                for e, n, s in zip(met.tolist(), np.diff([*at, len(order)]).tolist(), sums.tolist(), strict=True):
                    was = told.get((p, e))
                    told[p, e] = (n, s) if was is None else (was[0] + n, [a + b for a, b in zip(was[1], s, strict=True)])
        made = [(p, e, n, [str(v) for v in s]) for (p, e), (n, s) in told.items()]
        if made:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    return rows.select("x").mapInArrow(work, "part int, entry int, n long, total array<string>")


def _means(sums: DataFrame) -> DataFrame:
    """(part, entry, mean): the componentwise floor of sum / count of each entry."""

    def merge(group):
        import pyarrow as pa

        n = sum(group.column("n").to_pylist())
        total = [sum(int(v) for v in at) for at in zip(*group.column("total").to_pylist(), strict=True)]
        mean = pa.array([[str(v // n) for v in total]], pa.list_(pa.string()))
        return pa.table({"part": group.column("part").slice(0, 1), "entry": group.column("entry").slice(0, 1), "mean": mean})

    return sums.groupBy("part", "entry").applyInArrow(merge, "part int, entry int, mean array<string>")


def train(rows: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """Codebooks for usable rows (vec_id, x) of length dim: for each part an array of its entries. Entries that no part chose stay."""
    context, width = rows.sparkSession.sparkContext, -(-dim // PARTS)
    books = first_books(rows, width, entries)
    for _ in range(rounds):
        sent = context.broadcast(books)
        means = _means(_sums(rows, sent, width)).collect()  # PARTS x entries rows
        books = [b.astype(object) for b in books]
        for r in means:
            books[r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
        sent.destroy()
    return books


def encode(rows: DataFrame, books: list, dim: int) -> DataFrame:
    """(vec_id, label, code, error): the indexes of the nearest entries, two hex digits each, and the sum of their squared distances.

    A vector of another length than dim has neither code nor error. An error beyond 64 bits is given as their greatest number.
    """
    width, sent = -(-dim // PARTS), rows.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in sliced(batches, 4096):
            same = pc.equal(pc.list_value_length(batch.column("x")), dim)
            for part, fits in ((batch.filter(same), True), (batch.filter(pc.invert(same)), False)):
                code, error = [None] * part.num_rows, [None] * part.num_rows
                if fits and part.num_rows:
                    index, far = nearest(_parts(part, width), sent.value)
                    code = [bytes(row).hex() for row in index.tolist()]
                    error = [min(TOP, sum(row)) for row in far.tolist()]
                made = [part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: list, dim: int) -> DataFrame:
    """codes(vec_id, code, ...) with a column ``x``: the vector that the code stands for."""
    width, sent = -(-dim // PARTS), codes.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            made = []
            for code in batch.column("code").to_pylist():
                at = bytes.fromhex(code) if code is not None else None
                x = None if at is None else np.concatenate([sent.value[p][e] for p, e in enumerate(at)])[:dim]
                made.append(None if x is None else [float(v) / SCALE for v in x])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.list_(pa.float64()))], names=["vec_id", "x"])

    if width == 0:
        return codes.select("vec_id", F.array().cast("array<double>").alias("x"))
    return codes.select("vec_id", "code").mapInArrow(work, "vec_id long, x array<double>")


def digest(books: list) -> str:
    """sha256 of all components as decimal integers by part, entry and position, joined by commas."""
    import hashlib

    return hashlib.sha256(",".join(str(int(v)) for b in books for entry in b for v in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded(vec_id, label, code, error) with label_error: the sum over all rows of the label, null being a label of its own.

    Sums are partial in each task, then joined: broadcast where labels are few by count, else with the rows of a label dealt over
    SALTS keys, so that a label of a third of all rows is no one task's work.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = sums.select("of", F.when(F.col("total") > TOP, F.lit(TOP)).otherwise(F.col("total").cast("long")).alias("label_error"))
    if coded.select("label").distinct().count() <= LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    spread = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to"))).drop("of", "salt", "to")


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each usable row of vectors.

    Rows whose vector is null or holds null or non-finite components are dropped. Codebooks fit vectors of the commonest length
    (the least on ties); a vector of another length keeps its row with null code and error. A length that PARTS does not divide
    is filled up with zeros. Finite components of any size are coded exactly; sums beyond 64 bits are given as their greatest
    number. Of repeated ids each row counts; null ids come after all others. Fewer rows than entries give smaller codebooks. An
    empty table gives an empty result; further columns are ignored. Each round reads the table anew: nothing but codebooks is
    kept between rounds, so a lost executor costs its tasks only.
    """
    rows = usable(vectors, id_column, column, label)
    dim = _commonest(rows)
    if dim is None:
        return rows.select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    books = train(rows.where(F.size("x") == dim), dim, entries, rounds)
    coded = Scratch(rows.sparkSession).put(encode(rows, books, dim), "codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def oracle() -> str:
    """The same for DuckDB, a step of SQL for each round."""
    apart = "list_sum(list_transform(list_zip(x.v, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    near = f"""select x.vec_id, x.part, any_value(x.v) as v, min({apart} * {ENTRIES} + b.entry) % {ENTRIES} as entry,
      min({apart}) as far from x join {{book}} b using (part) group by x.vec_id, x.part"""
    steps = [
        f"""kept as (select vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as q
      from embeddings where embedding is not null
        and coalesce(list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))), true)),
    x as materialized (select vec_id, p.part, q[p.part * (len(q) // {PARTS}) + 1 : (p.part + 1) * (len(q) // {PARTS})] as v
      from kept, (select unnest(range({PARTS})) as part) p),
    book0 as materialized (select x.part, r.entry, x.v as c from x
      join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}) r using (vec_id))"""
    ]
    for i in range(ROUNDS):
        steps.append(f"""near{i} as materialized ({near.format(book=f"book{i}")}),
    said{i} as (select part, entry, unnest(v) as c, unnest(range(len(v))) as pos from near{i}),
    mean{i} as (select part, entry, pos, cast(floor_div as bigint) as c from (
      select part, entry, pos, sum(c) as s, count(*) as n, (s - ((s % n) + n) % n) // n as floor_div from said{i} group by all)),
    book{i + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from book{i} b left join (
      select part, entry, list(c order by pos) as c from mean{i} group by all) m using (part, entry))""")
    return f"""with {", ".join(steps)},
    last as ({near.format(book=f"book{ROUNDS}")}),
    coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(far) as bigint) as error
      from last group by vec_id),
    told as (select sha256(string_agg(c, ',' order by part, entry)) as codebooks_sha256
      from (select part, entry, array_to_string(c, ',') as c from book{ROUNDS}))
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
    from coded join kept using (vec_id), told"""
