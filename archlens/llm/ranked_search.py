"""Ranked search of whole texts by a blocked sparse matrix product, in integers.

1. ``postings``: each document's terms and their counts, written once; a text is read by one pass of byte translation, splitting
   and counting. Where the items hold few terms in all, by count, other terms are left out.
2. N, L and df are sums over that table.
3. Items come in blocks of bounded size: their rows (term, multiplicity) are one sparse matrix, which is broadcast. A batch of
   documents is the other: term rows of (document, impact). Their product is made row by row (Gustavson): an item's row adds up
   the rows of its terms, each times its multiplicity, in 64-bit integers, and only the k best documents of a row are kept.
4. Rows of k are reduced twice: over the batches of a task in the task, then by a window over (item, part) and over items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import Scratch, sliced

#: A term: a run of ASCII letters, ASCII digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Terms of all items up to which documents' other terms are left out (their set is sent to every task).
VOCABULARY = 1_000_000
#: Terms of items (with an item) in a block, about; documents multiplied at once; parts over which an item's rows are reduced first.
ITEM_TERMS, DOCS, SPLITS = 1_000_000, 4096, 64


def _fold() -> bytes:
    """A table for bytes.translate: A-Z in lower case, bytes that are in no term as blanks."""
    kept = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
    return bytes((b + 32 if 65 <= b < 91 else b) if b in kept else 32 for b in range(256))


def postings(texts: DataFrame, id_column: str, only=None) -> DataFrame:
    """(id, n, terms, counts) of each row with a term: n terms with repeats, each distinct one (UTF-8) and how often it occurs.

    ``only``, a broadcast set, leaves out other terms; n counts them all the same.
    """

    def work(batches: Iterator):
        from collections import Counter

        import pyarrow as pa

        fold, schema = _fold(), pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
        wanted = only.value if only is not None else None
        for batch in sliced(batches):
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().translate(fold).split() if text.is_valid and len(text.as_buffer()) else []
                if words:
                    met = Counter(words)
                    if wanted is not None:
                        met = {w: met[w] for w in met.keys() & wanted}
                    terms = sorted(met)
                    out.append((i, len(words), terms, [met[w] for w in terms]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = texts.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, n long, terms array<binary>, counts array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df + 1)))


def _impacts(tf, n, n_docs: int, n_terms: int):
    """(1000000000 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L; by Python's integers where 64 bits would not do."""
    import numpy as np

    wide = np.int64 if 75 * int(n.max(initial=0)) * n_docs < 2**62 and int(tf.max(initial=0)) < 2**33 else object
    m = 25 + 75 * n.astype(wide) * n_docs // n_terms
    return ((1_000_000_000 * tf.astype(wide)) // (1000 * tf.astype(wide) + 8 * m)).astype(np.int64)


def best(score, ids, valid, k: int):
    """Places of the k highest scores above 0, the lower id first on ties, rows without id last."""
    import numpy as np

    at = np.flatnonzero(score > 0)
    if len(at) > k:
        floor = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= floor]
    return at[np.lexsort((ids[at], ~valid[at], -score[at]))[:k]]


def _product(docs: DataFrame, block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each item of a block in each task.

    block, broadcast: terms in order, their weights, and for each item the places of its terms and their multiplicities.
    """

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, weights, items = block.value
        values = pa.array(terms, pa.binary())
        held: list = [None] * len(items)
        for batch in sliced(batches, DOCS):
            if not batch.num_rows:
                continue
            lists = batch.column("terms")
            flat = pc.index_in(lists.flatten(), value_set=values)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            term = flat.fill_null(0).to_numpy()[known]
            doc = pc.list_parent_indices(lists).to_numpy()[known]
            n = batch.column("n").to_numpy()
            value = _impacts(batch.column("counts").flatten().to_numpy()[known], n[doc], n_docs, n_terms) * weights[term]
            order = np.argsort(term, kind="stable")
            doc, value = doc[order], value[order]
            start = np.searchsorted(term[order], np.arange(len(terms) + 1))
            ids, valid = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for i, (places, times) in enumerate(items):
                row = np.zeros(batch.num_rows, np.int64)
                for t, times_t in zip(places.tolist(), times.tolist(), strict=True):
                    a, b = start[t], start[t + 1]
                    if a < b:
                        row[doc[a:b]] += times_t * value[a:b]
                at = best(row, ids, valid, k)
                if len(at):
                    mine = (row[at], ids[at], valid[at])
                    if held[i] is not None:
                        mine = tuple(np.concatenate(x) for x in zip(held[i], mine, strict=True))
                        top = best(*mine, k)
                        mine = tuple(x[top] for x in mine)
                    held[i] = mine
        for i, mine in enumerate(held):
            if mine is not None:
                score, ids, valid = mine
                made = [pa.array([i] * len(ids), pa.int32()), pa.array(ids, pa.int64(), mask=~valid), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["item", "id", "score"])

    return docs.mapInArrow(work, "item int, id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_terms: int = ITEM_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs(doc_id, text, ...) with the highest scores above 0 for each item of
    items(item_id, text, ...), equal scores by ascending doc_id.

    Null and empty texts and texts without terms find nothing and are never found; N, L and df do not count them. Rows that repeat
    a doc_id are documents of their own; one without id ranks after its equals. Rows that repeat an item_id are one item that holds
    the terms of all; so are items without id. Empty tables give an empty result; further columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = postings(items, "item_id").select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    asked = scratch.put(asked.groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("times")), "asked")
    words = asked.select("term").distinct()
    only = None
    if words.count() <= vocabulary:
        only = spark.sparkContext.broadcast(frozenset(words.toArrow().column(0).to_pylist()))
    index = scratch.put(postings(docs, "doc_id", only), "postings")
    total = index.agg(F.count("*").alias("docs"), F.sum(F.col("n").cast("decimal(38,0)")).alias("terms")).first()
    n_docs, n_terms = total["docs"], int(total["terms"] or 0)
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    met = scratch.put(asked.join(df, "term"), "met")

    # Items in blocks of about as many rows as a parameter says: a block is all that the driver and a task ever hold.
    sizes = met.groupBy("item").agg(F.count("*").alias("n"))
    blocks = max(1, -(-met.count() // item_terms))
    found = None
    for b in range(blocks):
        part = met.join(sizes.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select(F.col("item").alias("i")), F.col("item").eqNullSafe(F.col("i"))).drop("i")
        rows = part.toArrow().to_pydict()
        terms = sorted(set(rows["term"]))
        if not terms:
            continue
        names, got = _rows(rows, terms, n_docs)
        product = scratch.put(_product(index, spark.sparkContext.broadcast(got), n_docs, n_terms, k), "product")
        known = spark.createDataFrame(list(enumerate(names)), "at int, item_id long")
        out = product.join(F.broadcast(known), F.col("item") == F.col("at")).select("item_id", F.col("id").alias("doc_id"), "score")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    split = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPLITS))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = found.withColumn("split", split).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "split").orderBy(*order)))
    last = first.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _rows(rows: dict, terms: list[bytes], n_docs: int):
    """(item ids, (terms, weights, rows)) of one block: each item's places of terms and multiplicities as arrays."""
    import numpy as np

    place = {t: i for i, t in enumerate(terms)}
    df = dict(zip(rows["term"], rows["df"], strict=True))
    by_item: dict = {}
    for item, term, times in zip(rows["item"], rows["term"], rows["times"], strict=True):
        by_item.setdefault(item, []).append((place[term], times))
    names = sorted(by_item, key=lambda i: (i is None, i or 0))
    matrix = [tuple(np.array(c, np.int64) for c in zip(*sorted(by_item[i]), strict=True)) for i in names]
    return names, (terms, np.array([weight(n_docs, df[t]) for t in terms], np.int64), matrix)


#: The same for DuckDB.
ORACLE = r"""
with said as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
posted as (select doc_id, term, count(*) as tf from said group by all),
sized as (select doc_id, sum(tf) as n from posted group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from sized),
held as (select term, count(*) as df from posted group by term),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
scored as (
  select a.item_id, p.doc_id, cast(sum(a.times * cast(floor(1000 * ln((2.0::double * t.docs + 2) / (2 * h.df + 1))) as bigint)
    * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + cast(75 * s.n * t.docs as bigint) // t.terms)))) as bigint) as score
  from asked a join held h using (term) join posted p using (term) join sized s using (doc_id), total t
  group by a.item_id, p.doc_id)
select item_id, cast(row_number() over w as integer) as rank, doc_id, score from scored where score > 0
window w as (partition by item_id order by score desc, doc_id) qualify row_number() over w <= 10
"""
