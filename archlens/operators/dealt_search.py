"""Many questions against an index of ranked text: postings are dealt to tasks as blocks of numbers, and a task searches all it is dealt.

No pair of a question and a document leaves a task, only the best hits of each question in each block. Questions that ask for the same terms
and hint at the same kind are searched once. The terms of a question are taken from the rarest to the commonest: documents of the rarest are
looked up in the others, and of those without it only the best hits of the other terms can be hits, since each document before them there is
before them here too. What those other terms find is kept, for many questions end with the same common terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.functions.text import kind_hint
from archlens.operators.graph import WIDE_ROWS, cut, numbered, wide
from archlens.operators.ranking import COVERAGE, FLOOR

#: Postings of a block, 16 bytes each in a task; answers for common terms that a task keeps; tasks for each core.
POSTS, KEPT, WAVES = 16_000_000, 20_000, 2
#: Kinds that a question can hint at, from 1 on.
HINTS = ("layer", "file", "symbol")
#: What rounding may take from a bound, and digits that count in a comparison of scores.
SLACK, DIGITS = 1e-6, 1e9


class Postings:
    """Of each term of a block: documents in order, what the term adds to each, and a tag, 8 times its rows and the number of its kind."""

    def __init__(self, terms, docs, values, tags):
        import numpy as np

        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        if not first.all():  # rows that repeat an id add up
            at = np.flatnonzero(first)
            tags = tags[at] % 8 + 8 * np.add.reduceat(tags // 8, at)
            terms, docs, values = terms[at], docs[at], np.add.reduceat(values, at)
        self.docs, self.values, self.tags = docs, values, tags
        self.most = int(tags.max(initial=8)) // 8
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        best = np.maximum.reduceat(values, starts) if len(starts) else values
        self.spans = dict(zip(terms[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)], best.tolist(), strict=True), strict=True))
        self.kept: dict = {}

    @classmethod
    def of_chunks(cls, chunks: list) -> Postings:
        import numpy as np

        parts: tuple = ([], [], [], [])
        for data in chunks:
            n, runs = np.frombuffer(data, np.int32, 2)
            at = 8
            head = np.frombuffer(data, np.int32, 2 * runs, at)
            parts[0].append(np.repeat(head[:runs], head[runs:]))
            at += 8 * int(runs)
            for to, kind in ((parts[1], np.int32), (parts[3], np.int32), (parts[2], np.float64)):
                to.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
        chunks.clear()
        whole = []
        for part, kind in zip(parts, (np.int32, np.int32, np.float64, np.int32), strict=True):
            whole.append(np.concatenate(part) if part else np.empty(0, kind))
            part.clear()
        return cls(*whole)

    def best(self, terms: tuple, least: float, hint: int, hits: int):
        """(documents, scores, rows matched, tags) of the best hits: FLOOR at least, ``least`` rows matched, in order."""
        import numpy as np

        spans = [s for s in map(self.spans.get, terms) if s is not None]
        if len(spans) * self.most < least or sum(s[2] for s in spans) < FLOOR - SLACK:
            return None
        (lo, hi, _), others = spans[0], spans[1:]
        bound = sum(s[2] for s in others)
        key = (terms[terms.index(next(t for t in terms if t in self.spans)) + 1 :], least, hint)
        rest, known = self.kept.get(key), key in self.kept
        need = rest[1][-1] if rest is not None and len(rest[0]) == hits else FLOOR
        docs, score, tags = self.docs[lo:hi], self.values[lo:hi], self.tags[lo:hi]
        matched = None
        if bound + spans[0][2] >= need - SLACK:
            near = score >= need - bound - SLACK
            docs, score, tags = docs[near], score[near], tags[near]
            matched = tags // 8
            for a, b, _ in others:
                theirs = self.docs[a:b]
                at = np.minimum(np.searchsorted(theirs, docs), b - a - 1)
                found = theirs[at] == docs
                at = at[found] + a
                score[found] += self.values[at]
                matched[found] += self.tags[at] // 8
            mine = _first(docs, score, matched, tags, least, hint, hits)
        else:
            mine = None
        if not known and others:
            if mine is not None and len(mine[0]) == hits and bound < mine[1][-1] - SLACK:
                return mine
            rest = self.best(key[0], least, hint, hits)
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[key] = rest
        if rest is None:
            return mine
        # Hits of the other terms that hold this one as well are found above, with all they score.
        own = self.docs[lo:hi]
        alone = own[np.minimum(np.searchsorted(own, rest[0]), hi - lo - 1)] != rest[0]
        rest = tuple(x[alone] for x in rest)
        return rest if mine is None else _first(*(np.concatenate(x) for x in zip(mine, rest, strict=True)), least, hint, hits)


def _first(docs, score, matched, tags, least: float, hint: int, hits: int):
    import numpy as np

    exact = np.rint(score * DIGITS)
    at = np.flatnonzero((matched >= least) & (exact >= FLOOR * DIGITS))
    if not len(at):
        return None
    if len(at) > hits:
        at = at[exact[at] >= np.partition(exact[at], len(at) - hits)[len(at) - hits]]
    at = at[np.lexsort((docs[at], (tags[at] % 8 != hint) | (hint == 0), -exact[at]))[:hits]]
    return docs[at], score[at], matched[at], tags[at]


def _chunks(batches):
    """(block, at, sub, data) of rows(block, term, doc, value, tag) in order: as many of a batch as are of one block. A term lies in one partition,
    and what is cut of it stays together in order of at, the partition and the first term, and sub, its first document."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    for b in batches:
        block, term, doc, tag, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "term", "doc", "tag", "value"))
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = term[lo:hi].astype(np.int32)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            head = np.concatenate([[hi - lo, len(starts)], own[starts], np.diff(starts, append=hi - lo)]).astype(np.int32)
            data = b"".join(x.tobytes() for x in (head, doc[lo:hi].astype(np.int32), tag[lo:hi].astype(np.int32), value[lo:hi].astype(np.float64)))
            yield pa.record_batch([pa.array([int(block[lo])], pa.int32()), pa.array([part + int(own[0])], pa.int64()), pa.array([int(doc[lo])], pa.int64()), pa.array([data], pa.binary())], names=["block", "at", "sub", "data"])


def search(index, asked: DataFrame, questions: DataFrame, hits: int) -> DataFrame:
    """What `text_index.search` finds: asked(qid, n, term, idf, df) are the questions whose terms are all known and can reach the floor, cut."""
    spark = questions.sparkSession
    words, n_words = numbered(asked.groupBy(F.col("term").alias("id")).agg(F.first("idf").alias("idf"), F.first("df").alias("df")))
    words = cut(words.select(F.col("id").alias("term"), "idf", "df", F.col("place").cast("int").alias("t")))
    n_posts = words.agg(F.sum("df")).first()[0] or 0
    words = words.hint("merge") if n_words > WIDE_ROWS else words
    kinds = F.coalesce(*[F.when(F.col("p.kind") == k, i) for i, k in enumerate(HINTS, 1)], F.lit(0))
    posts = index.blocks.select("term", "posts").join(words.select("term", "t", "idf"), "term").select("t", "idf", F.explode("posts").alias("p"))
    posts = posts.select("t", F.col("p.id").alias("id"), F.col("p.kind").alias("kind"), (8 + kinds).cast("int").alias("tag"), (F.col("idf") * F.col("p.part")).alias("value"))
    docs, n_docs = numbered(posts.select("id", "kind").distinct())
    docs = wide(cut(docs.select("id", "kind", F.col("place").cast("int").alias("doc"))))
    blocks = max(1, -(-n_posts // POSTS))
    each = max(1, -(-n_docs // blocks))
    own = docs.select(F.col("id").alias("i"), F.col("kind").alias("k"), "doc")
    coded = posts.join(own, F.col("id").eqNullSafe(F.col("i")) & F.col("kind").eqNullSafe(F.col("k")))
    coded = coded.select(F.expr(f"cast(doc div {each} as int)").alias("block"), F.col("t").alias("term"), "doc", "tag", "value")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(coded.repartition(parts, "block", "term").sortWithinPartitions("block", "term", "doc").mapInArrow(_chunks, "block int, at long, sub long, data binary"))

    # A question is its terms, the rarest first, and its hint: those that are the same are searched once.
    hint = F.coalesce(F.array_position(F.array(*map(F.lit, HINTS)), kind_hint(F.col("question"))), F.lit(0))
    terms = asked.join(words.select("term", "t"), "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    terms = terms.join(questions.select("qid", hint.alias("hint")), "qid")
    told = cut(terms.select("qid", F.concat_ws(" ", F.col("hint").cast("string"), F.array_join(F.transform("ts", lambda x: x["t"].cast("string")), " ")).alias("key")))
    keys = told.select("key").distinct()
    groups = max(1, -(-WAVES * spark.sparkContext.defaultParallelism // blocks))
    # Longer questions that end alike go to one task, one after another.
    words_ = F.split("key", " ")
    like = F.when(F.size(words_) > 3, F.xxhash64(F.slice(words_, 3, 1000))).otherwise(F.xxhash64("key"))
    group = F.pmod(like, F.lit(groups)).cast("int")
    graph = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", F.lit(0).alias("role"), "at", "sub", "data", F.lit(None).cast("string").alias("key"))
    mine = keys.select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), like.alias("at"), F.lit(0).cast("long").alias("sub"), F.lit(None).cast("binary").alias("data"), "key")
    rows = graph.unionByName(mine).repartitionById(blocks * groups, (F.col("block") * groups + F.col("g")).cast("int")).sortWithinPartitions("role", "at", "sub", "key")

    def work(batches):
        import pyarrow as pa

        chunks: list = []
        held, out = None, ([], [], [], [], [])

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["key", "doc", "score", "matched", "liked"])
            for c in out:
                c.clear()
            return batch

        for b in batches:
            role, data, key = b.column("role").to_pylist(), b.column("data"), b.column("key")
            for i, r in enumerate(role):
                if r == 0:
                    chunks.append(data[i].as_py())
                    continue
                held = held or Postings.of_chunks(chunks)
                said = key[i].as_py()
                hint, *terms = map(int, said.split(" "))
                found = held.best(tuple(terms), COVERAGE * len(terms), hint, hits)
                if found is not None:
                    docs, score, matched, tags = (x.tolist() for x in found)
                    for c, x in zip(out, ([said] * len(docs), docs, score, matched, [hint > 0 and t % 8 == hint for t in tags]), strict=True):
                        c.extend(x)
                    if len(out[0]) >= 20_000:
                        yield made()
        if out[0]:
            yield made()

    from pyspark.sql import Window

    found = rows.mapInArrow(work, "key string, doc int, score double, matched long, liked boolean")
    order = Window.partitionBy("key").orderBy(F.round("score", 9).desc(), F.col("liked").desc(), "doc")  # documents are numbered by their ids
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hits)
    spelled = best.join(docs.select("doc", "id"), "doc").select("key", "rank", "id", F.round("score", 6).alias("score"), "matched")
    return spelled.join(told.hint("merge"), "key").select("qid", "rank", "id", "score", "matched")
