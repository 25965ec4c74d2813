"""Recursive dataflow over edge tables: search from many seeds at once, closure, components, layering.

A search visits level after level; only rows new in a level are expanded. Of the chains that reach a node in the same
level the smallest is kept, which is the chain that a first-in-first-out search over sorted neighbours finds.

There are three ways, with equal results. A graph of at most ``LOCAL_PAIRS`` pairs, which is counted first, is sent to the executors as
arrays of numbers: each question is searched by one task, a level at a time, and all questions are one job. Of a larger one the names are
numbered and the pairs coded by joins, and the blocks of numbers are checkpointed once and read by as many tasks as run at once, so that
neither graph nor chain passes through the driver or a shuffle: a task keeps a parent for each node and writes chains out as it returns rows. If
only the names are too much for a task, and no chains of all that is reached are wanted, they stay a table that the found places are joined with. A
graph of which a task would hold more than ``TASK_BYTES`` stays a table: each level of all questions is a join, checkpointed, so plans stay
short and a lost executor repeats no level.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from bisect import bisect_left
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge types that are drawn but are no dependency.
IGNORED = ("realtime",)
#: Pairs that are broadcast at most: 12 bytes each, and the names of their ends once.
LOCAL_PAIRS = 1_000_000
#: Bytes of a graph that one task holds at most: 4 for each pair, 8 for each node, and the names.
TASK_BYTES = 800_000_000
#: Rows from which on a table is joined by sorting: the size of what is cut is still estimated from compressed columns, and names are long.
WIDE_ROWS = 200_000
#: Pairs that a task looks at in one step.
STEP_PAIRS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which a cluster must name; a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="archlens-checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def wide(df: DataFrame) -> DataFrame:
    """df, which should be cut, counted: one of many rows is never broadcast, nor is what is selected, exploded or grouped from it."""
    return df.hint("merge") if df.count() > WIDE_ROWS else df


def adjacency(edges: DataFrame, reverse: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """(src, dst) of dependency edges, turned round if asked; pairs may repeat."""
    kept = edges.where(~F.col("type").isin(*IGNORED)) if "type" in edges.columns else edges
    if types is not None:
        kept = kept.where(F.col("type").isin(*types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return kept.select(F.col(a).alias("src"), F.col(b).alias("dst"))


class Arrays:
    """A graph as arrays: sorted names, and for each the places of its neighbours, in order and once each."""

    def __init__(self, names, starts, ends, weights=None, back=None):
        """names may be null, then places stand for them; back: the same graph turned round, if it is at hand."""
        self.names, self.starts, self.ends, self.weights, self.back, self.marks = names, starts, ends, weights, back, None

    @classmethod
    def of(cls, pairs: DataFrame, names: DataFrame | None = None) -> Arrays | None:
        """Null where the graph has more pairs than are broadcast; pairs are cut, since they are counted first. See `search` for names."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if pairs.count() > LOCAL_PAIRS:
            return None
        found = spelled(pairs, names).toArrow()
        both = pa.chunked_array([*found.column("src").chunks, *found.column("dst").chunks], found.schema.field("src").type).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        names = both.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[both.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
        n = len(names)
        keys, at = np.unique(codes[: found.num_rows] * max(1, n) + codes[found.num_rows :], return_index=True)
        src, dst = np.divmod(keys, max(1, n))
        weights = found.column("weight").to_numpy()[at].astype(np.int8) if "weight" in found.column_names else None
        return cls(names, np.searchsorted(src, np.arange(n + 1)), dst, weights)

    @classmethod
    def of_blocks(cls, names: dict, pairs: dict, weights: dict, back: dict, n: int | None = None) -> Arrays:
        """From the blocks that a task was dealt, by their first place; they are used up. n: the number of nodes, if there are no names."""
        import numpy as np
        import pyarrow as pa

        if n is not None:
            return cls._coded(None, n, pairs, weights, back)
        texts = [pa.ipc.open_stream(names[at]).read_all().column(0).combine_chunks() for at in sorted(names)]  # views of the blocks
        names.clear()
        size = [np.frombuffer(t.buffers()[1], np.int32)[[t.offset, t.offset + len(t)]] for t in texts]
        offsets, letters = np.zeros(sum(map(len, texts)) + 1, np.int32), np.empty(sum(hi - lo for lo, hi in size), np.uint8)
        i, filled = 0, 0
        for (lo, hi), k in zip(size, range(len(texts)), strict=True):
            t, texts[k] = texts[k], None
            offsets[i + 1 : i + len(t) + 1] = np.frombuffer(t.buffers()[1], np.int32)[t.offset + 1 : t.offset + len(t) + 1] + (filled - lo)
            letters[filled : filled + hi - lo] = np.frombuffer(t.buffers()[2], np.uint8)[lo:hi] if hi > lo else 0
            i, filled = i + len(t), filled + hi - lo
        whole = pa.StringArray.from_buffers(i, pa.py_buffer(offsets), pa.py_buffer(letters))
        return cls._coded(whole, len(whole), pairs, weights, back)

    @classmethod
    def _coded(cls, names, n: int, pairs: dict, weights: dict, back: dict) -> Arrays:
        import numpy as np

        many = np.zeros(n + 1, np.int64)
        ends = np.empty(sum(np.frombuffer(b, np.int32, 1)[0] for b in pairs.values()), np.int32)
        filled = 0
        for at in sorted(pairs):
            block = np.frombuffer(pairs.pop(at), np.int32)
            k, first = block[:2]
            many[first + 1 : first + 1 + len(block) - 2 - k] += block[2 + k :]
            ends[filled : filled + k] = block[2 : 2 + k]
            filled += k
        heavy = np.concatenate([np.frombuffer(weights.pop(at), np.int8) for at in sorted(weights)]) if weights else None
        return cls(names, np.cumsum(many, out=many), ends, heavy, cls._coded(names, n, back, {}, {}) if back else None)

    def turned(self) -> Arrays:
        """The graph turned round."""
        import numpy as np

        if self.back is None:
            n = len(self.starts) - 1
            counts = np.bincount(self.ends, minlength=n) if len(self.ends) else np.zeros(n, np.int64)
            order = np.argsort(self.ends, kind="stable")
            self.back = Arrays(self.names, np.concatenate(([0], np.cumsum(counts))), np.repeat(np.arange(n), np.diff(self.starts))[order])
        return self.back

    def spell(self, places):
        import pyarrow as pa

        return pa.array(places, pa.int64()) if self.names is None else self.names.take(pa.array(places))

    def near(self, level):
        """All neighbours of a level, in order and once each."""
        import numpy as np

        return np.unique(np.concatenate([self.ends[:0], *(near for near, _, _ in self.next_of(level))]))

    def route(self, start: int, goal: int) -> list | None:
        """The smallest of the shortest chains from start to goal, or null. Levels grow from both ends, always that with fewer pairs, until they
        meet, so that a question costs the few nodes near its ends and not the graph; then the smallest next node is taken that is on a way."""
        import numpy as np

        if start == goal:
            return [start]
        sides = (self, self.turned())
        if self.marks is None:
            self.marks = tuple(np.zeros(len(self.starts) - 1, bool) for _ in sides)  # kept for the next question
        grown = [[np.array([start])], [np.array([goal])]]
        for mark, levels in zip(self.marks, grown, strict=True):
            mark[levels[0]] = True
        met = None
        cost = [int((g.starts[x[0] + 1] - g.starts[x[0]]).sum()) for g, x in zip(sides, grown, strict=True)]
        while met is None:
            at = 0 if cost[0] <= cost[1] else 1
            fresh = sides[at].near(grown[at][-1]) if cost[at] else np.empty(0, np.int64)
            fresh = fresh[~self.marks[at][fresh]]
            if not len(fresh):
                break
            self.marks[at][fresh] = True
            grown[at].append(fresh)
            cost[at] = int((sides[at].starts[fresh + 1] - sides[at].starts[fresh]).sum())
            both = fresh[self.marks[1 - at][fresh]]
            met = both if len(both) else None
        for mark, levels in zip(self.marks, grown, strict=True):
            for level in levels:
                mark[level] = False
        if met is None:
            return None
        # Nodes on a shortest way, by their distance from the start: back from where the levels met, then on by the other side's levels.
        ways = [met]
        for level in reversed(grown[0][:-1]):
            ways.append(np.intersect1d(sides[1].near(ways[-1]), level, assume_unique=True))
        ways = ways[::-1] + grown[1][-2::-1]
        chain = [start]
        for way in ways[1:]:
            chain.append(int(np.intersect1d(self.near(np.array(chain[-1:])), way, assume_unique=True)[0]))
        return chain

    def place(self, names) -> dict:
        """Places of names that the graph has; its names are sorted by their bytes."""
        at = [bisect_left(range(len(self.names)), a.encode(), key=lambda i: self.names[i].as_py().encode()) for a in names]
        return {a: i for a, i in zip(names, at, strict=True) if i < len(self.names) and self.names[i].as_py() == a}

    def next_of(self, level):
        """(neighbour, place in level, weight of the pair or null) of all neighbours of a level, in order, some nodes of the level at a time."""
        import numpy as np

        many = self.starts[level + 1] - self.starts[level]
        total = many.cumsum()
        lo = 0
        while lo < len(level):
            before = total[lo] - many[lo]
            hi = max(lo + 1, int(np.searchsorted(total, before + STEP_PAIRS, "right")))
            part = many[lo:hi]
            at = np.arange(part.sum()) + np.repeat(self.starts[level[lo:hi]] - (total[lo:hi] - part - before), part)
            yield self.ends[at], np.repeat(np.arange(lo, hi), part), None if self.weights is None else self.weights[at]
            lo = hi

    def levels(self, seeds, most: int | None, goals=(), avoid=()) -> list:
        """(nodes, places of their parents in the level before, greatest weights of their chains or null) of each level: the nodes that it is
        the first to reach, in order of chains."""
        import numpy as np

        n = len(self.starts) - 1
        seen, goal, first = np.zeros(n, bool), np.zeros(n, bool), np.empty(n, np.int32)
        seen[list(avoid)] = True
        seen[seeds] = True
        goal[list(goals)] = True
        level = np.asarray(sorted(seeds), np.int32)
        heavy = None if self.weights is None else np.zeros(len(level), np.int8)
        out = [(level, level, heavy)]
        while not (goal[level].any() or len(out) - 1 == most):
            nodes, parents, weights = [], [], []
            for near, back, weight in self.next_of(level):
                fresh = ~seen[near]
                near, back, weight = near[fresh], back[fresh], None if weight is None else weight[fresh]
                number = np.arange(len(near), dtype=np.int32)
                first[near[::-1]] = number[::-1]  # of a node that comes again the first stays
                once = first[near] == number
                near, back, weight = near[once], back[once], None if weight is None else weight[once]
                seen[near] = True
                nodes.append(near.astype(np.int32))
                parents.append(back.astype(np.int32))
                weights.append(None if weight is None else np.maximum(weight, heavy[back]))
            level = np.concatenate(nodes) if nodes else level[:0]
            if not len(level):
                break
            heavy = None if self.weights is None else np.concatenate(weights)
            out.append((level, np.concatenate(parents), heavy))
        return out


def search(
    starts: DataFrame, pairs: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None, avoid: DataFrame | None = None, chains: bool = True, met: bool = False, names: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, depth, chain) of every node reached from starts(qid, id), the starts at depth 0; without max_depth, to the end.

    chain: the smallest of the shortest chains from a start; left out if ``chains`` is false. With targets(qid, id) a question stops at
    the level in which it first reaches one, and if ``met``, only targets are returned. Nodes of avoid(qid, id) are not entered.
    With names(key, id) the ends of pairs are keys, which are shorter to shuffle: a key stands for each of its ids, one without id for none.
    """
    return _search(starts, pairs, max_depth, targets, avoid, chains, met, None, names=names)


def first_reached(starts: DataFrame, pairs: DataFrame, most: int, max_depth: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """(qid, id, depth, chain, n, total): what `search` finds beyond the starts, in order of depth and chain: of each question its number
    from 1, the first ``most``, and the number of all."""
    return _search(starts, pairs, max_depth, None, None, True, False, most, names=names)


def heaviest(starts: DataFrame, calls: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(qid, id, depth, weight): what `search` finds beyond the starts over calls(src, dst, weight), each pair once, weights from 1 to 127;
    weight: the greatest of the pairs of the chain that search keeps. See `search` for names.

    A task that holds the graph carries the weights along as it searches, so no chain leaves it.
    """
    return _search(starts, calls.select("src", "dst", "weight"), None, None, None, False, False, None, True, names)


def spelled(pairs: DataFrame, names: DataFrame | None) -> DataFrame:
    """pairs by the ids of names(key, id) that their ends stand for."""
    if names is None:
        return pairs
    a, b = names.select(F.col("key").alias("src"), F.col("id").alias("a")), names.select(F.col("key").alias("dst"), F.col("id").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *[c for c in pairs.columns if c not in ("src", "dst")])


def _search(starts, pairs, max_depth, targets, avoid, chains: bool, met: bool, most: int | None, weighed: bool = False, names: DataFrame | None = None) -> DataFrame:
    pairs = cut(pairs.select("src", "dst", *(["weight"] if weighed else [])))
    arrays = Arrays.of(pairs, names)
    kind = dict(starts.dtypes)["qid"]
    role = lambda df, n: df.select("qid", F.col("id").cast("string").alias("id"), F.lit(n).alias("role"))
    asked = role(starts, 0)
    for n, df in ((1, targets), (2, avoid)):
        if df is not None:
            asked = asked.unionByName(role(df, n))
    asked = asked.distinct()
    schema = f"qid {kind}, id string, depth int" + (", chain array<string>" if chains else "") + (", n long, total long" if most is not None else "") + (", weight int" if weighed else "")
    # From one node to one other: levels from both ends find the chain.
    routed = met and targets is not None and avoid is None and max_depth is None and not weighed
    how = (max_depth, kind, chains, met, most, routed)
    if arrays is not None:
        sent = starts.sparkSession.sparkContext.broadcast(arrays)

        def work(batches):
            from itertools import groupby

            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("qid", "id", "role")), strict=True))
            for qid, mine in groupby(rows, key=lambda r: r[0]):
                mine = [(name, n) for _, name, n in mine]
                place = sent.value.place(sorted({name for name, _ in mine}))
                yield from _reached(sent.value, qid, [(name, n, place.get(name)) for name, n in mine], *how)

        return asked.repartition("qid").sortWithinPartitions("qid", "role", "id").mapInArrow(work, schema)
    blocks, size, spelt, n_nodes, bare = _blocks(pairs, names, routed)
    apart = size > TASK_BYTES >= bare and most is None and not weighed and (met or not chains)
    if size > TASK_BYTES and not apart:
        pairs = spelled(pairs, names)
        found = _search_joined(starts, pairs.select("src", "dst").distinct(), max_depth, targets, avoid)
        if weighed:
            return _weighed(found, pairs)
        if met:
            found = found.join(targets, ["qid", "id"], "left_semi")
        if most is not None:
            from pyspark.sql import Window

            mine = Window.partitionBy("qid")
            total = found.where("depth > 0").groupBy("qid").agg(F.count("*").alias("total"))
            ranked = found.where("depth > 0").withColumn("n", F.row_number().over(mine.orderBy("depth", "chain")).cast("long")).where(F.col("n") <= most)
            return ranked.join(total, "qid").select("qid", "id", "depth", "chain", "n", "total")
        return found if chains else found.drop("chain")
    if apart:
        blocks, size, names = blocks.where("kind <> 0"), bare, spelt.hint("merge") if n_nodes > WIDE_ROWS else spelt
        asked = cut(asked.join(names.withColumnRenamed("place", "spot"), "id", "left"))
    else:
        asked = asked.withColumn("spot", F.lit(None).cast("long"))
    questions, n = numbered(asked.groupBy("qid").agg(F.collect_list(F.struct("id", "role", "spot")).alias("rows")).withColumn("id", F.col("qid").cast("string")))
    slots = starts.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, slots if size <= TASK_BYTES // 4 else slots // 2))  # each holds the graph
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("qid", kind), ("id", "string"), ("role", "int"), ("spot", "long"))]
    blocks = cut(blocks).select("kind", "at", "block", *empty)
    given = schema.replace("id string", "id long").replace("array<string>", "array<long>") if apart else schema
    rows = questions.select((F.col("place") % tasks).alias("task"), "qid", F.explode("rows").alias("r"))
    mine = lambda t: rows.where(F.col("task") == t).select(F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("block"), "qid", "r.id", "r.role", "r.spot")

    def dealt(batches):
        graph, asked_ = _dealt(batches, n_nodes if apart else None)
        place = {} if apart else graph.place(sorted({name for mine in asked_.values() for name, *_ in mine}))
        for qid in list(asked_):
            yield from _reached(graph, qid, [(name, role, spot if apart else place.get(name)) for name, role, spot in asked_.pop(qid)], *how)

    # Each task reads the blocks where they were written: nothing of the graph is shuffled, however many tasks there are.
    found = [blocks.unionByName(mine(t)).coalesce(1).mapInArrow(dealt, given) for t in range(tasks)]
    # Parts of one partition each would be put together in one task; beside one of two partitions they stay apart. It has no rows, which
    # must not show from its plan.
    of = lambda f: (F.array("id") if f.name == "chain" else F.col("id")).cast(f.dataType)
    none = starts.sparkSession.range(0, 2, 1, 2).where("id < 0").select(*[of(f).alias(f.name) for f in found[0].schema])
    found = reduce(DataFrame.unionByName, found, none)
    return _named(found, asked, names, chains, met) if apart else found


def _named(found: DataFrame, asked: DataFrame, names: DataFrame, chains: bool, met: bool) -> DataFrame:
    """found, whose nodes are places, by names(id, place); with the starts of asked(qid, id, role, spot) that have no place."""
    chain = [F.array("id").alias("chain")] if chains else []
    alone = asked.where("role = 0 and spot is null").select("qid", "id", F.lit(0).alias("depth"), *chain)
    if met:
        alone = alone.join(asked.where("role = 1").select("qid", "id"), ["qid", "id"], "left_semi")
    if not chains:
        found = found.withColumnRenamed("id", "place").join(names, "place").select("qid", "id", "depth")
        return found.unionByName(alone)
    nodes = found.select("qid", F.col("id").alias("goal"), "depth", F.posexplode("chain").alias("k", "place")).join(names, "place")
    nodes = nodes.groupBy("qid", "goal", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("chain"))
    return nodes.select("qid", F.element_at("chain", -1).alias("id"), "depth", "chain").unionByName(alone)


def _weighed(found: DataFrame, calls: DataFrame) -> DataFrame:
    """found with the greatest weight of the hops of each chain in place of the chain, 0 at a start."""
    hops = found.where("depth > 0").select("qid", "id", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.struct(F.element_at("chain", i).alias("src"), F.element_at("chain", i + 1).alias("dst")))).alias("h")).select("qid", "id", "h.*")
    most = hops.join(calls, ["src", "dst"]).groupBy("qid", "id").agg(F.max("weight").cast("int").alias("weight"))
    return found.drop("chain").join(most, ["qid", "id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def _dealt(batches, n: int | None = None):
    """The graph of a task's blocks, and the rows (id, role, spot) of each of its questions. n: see `Arrays.of_blocks`."""
    held: dict = {0: {}, 1: {}, 3: {}, 4: {}}
    asked: dict = {}
    for b in batches:
        kinds, ats, blocks = b.column("kind").to_pylist(), b.column("at").to_pylist(), b.column("block")
        told = [b.column(c) for c in ("qid", "id", "role", "spot")] if "qid" in b.schema.names else []
        for i, (kind, at) in enumerate(zip(kinds, ats, strict=True)):
            if kind != 2:
                held[kind][at] = blocks[i].as_py()
            else:
                qid, *row = (c[i].as_py() for c in told)
                asked.setdefault(qid, []).append(tuple(row))
    return Arrays.of_blocks(*held.values(), n=n), asked


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids, whose ids are distinct, with their places and their number: places from 0 on in order of the ids, by ranges of them."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    told = cut(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").select(*ids.columns, part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("k")))
    offsets, n = [], 0
    for r in sorted(told.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((r["part"], n))
        n += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    return told.join(offset, "part").select(*ids.columns, (F.col("k") + F.col("offset")).alias("place")), n


def _blocks(pairs: DataFrame, names: DataFrame | None = None, both: bool = False) -> tuple[DataFrame, int, DataFrame, int, int]:
    """blocks(kind, at, block) of names and of coded pairs, with ``both`` turned round too; the bytes of the arrays made of them, the names(id,
    place) and their number, and the bytes without them."""
    if names is None:
        names, n = numbered(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct())
        keys = names.select(F.col("id").alias("key"), "place")
    else:
        names, n = numbered(names.groupBy("id").agg(F.collect_set("key").alias("keys")))
        keys = names.select(F.explode("keys").alias("key"), "place")
    keys = keys.hint("merge") if n > WIDE_ROWS else keys
    weighed = ["weight"] if "weight" in pairs.columns else []
    bare = ((4 + len(weighed)) * pairs.count() + 8 * n) * (2 if both else 1)
    size = bare + (names.agg(F.sum(F.octet_length("id"))).first()[0] or 0)
    a, b = keys.select(F.col("key").alias("src"), F.col("place").alias("a")), keys.select(F.col("key").alias("dst"), F.col("place").alias("b"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = pairs.join(a, "src").select("a", "dst", *weighed).join(b, "dst").select("a", "b", *weighed)
    coded = cut(coded) if both else coded
    spread = lambda df: df.repartitionById(parts, F.expr(f"cast(a * {parts} div {max(1, n)} as int)")).sortWithinPartitions("a", "b")

    def name_blocks(batches):
        import pyarrow as pa

        for t in batches:
            if t.num_rows:
                out = pa.BufferOutputStream()
                texts = pa.record_batch([t.column("id").cast(pa.string())], names=["id"])
                with pa.ipc.new_stream(out, texts.schema) as w:
                    w.write_batch(texts)
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([t.column("place")[0].as_py()], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["kind", "at", "block"])

    def pair_blocks(batches, kind=1):
        import numpy as np
        import pyarrow as pa

        last = -1
        for t in batches:
            key = t.column("a").to_numpy().astype(np.int64) * n + t.column("b").to_numpy()
            once = np.diff(key, prepend=last) > 0  # pairs may repeat
            key = key[once]
            if len(key):
                last = key[-1]
                src, dst = np.divmod(key, n)
                block = np.concatenate([[len(dst), src[0]], dst, np.bincount(src - src[0])]).astype(np.int32).tobytes()
                told = [(kind, block), *((3, t.column(w).to_numpy()[once].astype(np.int8).tobytes()) for w in weighed)]
                yield pa.record_batch([pa.array([k for k, _ in told], pa.int32()), pa.array([key[0]] * len(told), pa.int64()), pa.array([x for _, x in told], pa.binary())], names=["kind", "at", "block"])

    schema = "kind int, at long, block binary"
    blocks = names.select("id", "place").sortWithinPartitions("place").mapInArrow(name_blocks, schema).unionByName(spread(coded).mapInArrow(pair_blocks, schema))
    if both:
        turned = spread(coded.select(F.col("b").alias("a"), F.col("a").alias("b")))
        blocks = blocks.unionByName(turned.mapInArrow(lambda batches: pair_blocks(batches, 4), schema))
    return blocks, size, names.select("id", "place"), n, bare


def _reached(graph: Arrays, qid, asked: list, max_depth: int | None, kind: str, chains: bool, met: bool, most: int | None, routed: bool = False):
    """Batches of what one question reaches: asked has (name, role, place) of its starts, goals and nodes to avoid. Starts without edges reach
    themselves, unless the graph has no names. ``routed``: of one start and one goal only the chain between them is wanted."""
    import numpy as np
    import pyarrow as pa

    by: tuple = ([], [], [])
    for name, n, at in asked:
        by[n].append((name, at))
    told = lambda n: pa.array([qid] * n, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())
    names = ["qid", "id", "depth", *(["chain"] if chains else []), *(["n", "total"] if most is not None else []), *(["weight"] if graph.weights is not None else [])]
    goals = {name for name, _ in by[1]}
    own = sorted({name for name, at in by[0] if at is None})
    alone = set(own) & goals
    shown = sorted(alone) if met else own
    if shown and most is None and graph.names is not None:  # starts without edges reach themselves
        yield pa.RecordBatch.from_arrays([told(len(shown)), pa.array(shown), pa.array([0] * len(shown), pa.int32()), *([pa.array([[s] for s in shown], pa.list_(pa.string()))] if chains else []), *([pa.array([0] * len(shown), pa.int32())] if graph.weights is not None else [])], names=names)
    seeds = sorted({at for _, at in by[0] if at is not None})
    if not seeds:
        return
    at = lambda rows: [x for _, x in rows if x is not None]
    goal = sorted(set(at(by[1])))
    if routed and not alone and len(seeds) == 1 and len(goal) <= 1:
        route = graph.route(seeds[0], goal[0]) if goal else None
        if route is not None:
            yield pa.RecordBatch.from_arrays([told(1), graph.spell(goal), pa.array([len(route) - 1], pa.int32()), *([pa.ListArray.from_arrays(pa.array([0, len(route)], pa.int32()), graph.spell(route))] if chains else [])], names=names)
        return
    levels = graph.levels(seeds, 0 if alone else max_depth, at(by[1]), at(by[2]))
    total, number = sum(len(nodes) for nodes, *_ in levels[1:]), 0
    wanted = np.asarray(at(by[1]), np.int32)
    for depth, (nodes, _, heavy) in enumerate(levels):
        rows = np.flatnonzero(np.isin(nodes, wanted)) if met else np.arange(len(nodes))
        if most is not None:
            rows = rows[: most - number] if depth else rows[:0]
        for lo in range(0, len(rows), 20_000):
            part = rows[lo : lo + 20_000]
            columns = [told(len(part)), graph.spell(nodes[part]), pa.array(np.full(len(part), depth, np.int32))]
            if chains:
                chain, place = np.empty((len(part), depth + 1), np.int32), part
                for d in range(depth, -1, -1):
                    chain[:, d] = levels[d][0][place]
                    place = levels[d][1][place] if d else place
                flat = graph.spell(chain.ravel())
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, chain.size + 1, depth + 1), pa.int32()), flat))
            if most is not None:
                columns += [pa.array(np.arange(number + lo + 1, number + lo + 1 + len(part)), pa.int64()), pa.array(np.full(len(part), total), pa.int64())]
            if heavy is not None:
                columns.append(pa.array(heavy[part].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        number += len(rows)


def levels(max_depth: int | None):
    """Depths from 1 on, without an end where max_depth is None: the search ends with its frontier."""
    return count(1) if max_depth is None else range(1, max_depth + 1)


def _search_joined(starts: DataFrame, pairs: DataFrame, max_depth: int | None, targets: DataFrame | None, avoid: DataFrame | None) -> DataFrame:
    frontier = cut(starts.select("qid", "id").distinct().select("qid", "id", F.lit(0).alias("depth"), F.array("id").alias("chain")))
    seen = frontier
    for depth in levels(max_depth):
        if targets is not None:
            done = seen.join(targets, ["qid", "id"], "left_semi").select("qid").distinct()
            frontier = frontier.join(done, "qid", "left_anti")
        grown = frontier.join(pairs, frontier["id"] == pairs["src"]).select("qid", F.col("dst").alias("id"), F.concat("chain", F.array("dst")).alias("chain"))
        fresh = grown.groupBy("qid", "id").agg(F.min("chain").alias("chain")).join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        if avoid is not None:
            fresh = fresh.join(avoid, ["qid", "id"], "left_anti")
        frontier = cut(fresh.select("qid", "id", F.lit(depth).alias("depth"), "chain"))
        if frontier.isEmpty():
            break
        # The plan of a deep search stays short.
        seen = seen.unionByName(frontier) if depth % 16 else cut(seen.unionByName(frontier))
    return seen


def closure(pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct (src, dst) with a path of one edge or more. All pairs of a dense graph: meant for graphs of groups."""
    known = cut(pairs.select("src", "dst").distinct())
    fresh, depth = known, 1
    while max_depth is None or depth < max_depth:
        step = pairs.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        grown = fresh.join(step, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst")).distinct()
        fresh = cut(grown.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            break
        # What is known is not written again with each step; the plan of a deep closure stays short.
        known, depth = known.unionByName(fresh), depth + 1
        known = known if depth % 16 else cut(known)
    return known


def _components_of(graph: Arrays):
    """For each node the place of the first node of its strong component: one depth-first pass with a stack of open components."""
    import numpy as np

    n = len(graph.names)
    order, root_of = memoryview(np.full(n, -1, np.int64)), np.full(n, -1, np.int64)
    at, ends, done = memoryview(np.ascontiguousarray(graph.starts)), memoryview(np.ascontiguousarray(graph.ends)), memoryview(root_of)
    number, waiting, roots = 0, [], []
    for first in range(n):
        if order[first] >= 0:
            continue
        path = [(first, at[first])]
        order[first] = number
        number += 1
        waiting.append(first)
        roots.append(first)
        while path:
            node, edge = path[-1]
            if edge < at[node + 1]:
                path[-1] = (node, edge + 1)
                to = ends[edge]
                if order[to] < 0:
                    order[to] = number
                    number += 1
                    waiting.append(to)
                    roots.append(to)
                    path.append((to, at[to]))
                elif done[to] < 0:  # joins all components opened since
                    while order[roots[-1]] > order[to]:
                        roots.pop()
                continue
            path.pop()
            if roots and roots[-1] == node:
                roots.pop()
                where = len(waiting) - 1
                while waiting[where] != node:
                    where -= 1
                members = waiting[where:]
                del waiting[where:]
                root_of[members] = min(members)
    return root_of


def strong_components(nodes: DataFrame | None, pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest node that reaches it and is reached, from nodes(id), or if null the ends of pairs, and pairs(src, dst). See
    `search` for names.

    A graph that a task can hold is one depth-first pass of one task. In a larger one the greatest node that reaches each is
    spread along the edges; those that reach it back are its component and are taken out, until none is left.
    """
    spark = pairs.sparkSession
    pairs = cut(pairs.select("src", "dst"))
    arrays = Arrays.of(pairs, names)
    size = 0 if arrays is not None else None
    if arrays is None:
        blocks, size, *_ = _blocks(pairs, names)
    if size <= TASK_BYTES:
        sent = spark.sparkContext.broadcast(arrays)

        def work(batches):
            import numpy as np
            import pyarrow as pa

            if sent.value is not None:
                graph = sent.value
                for _ in batches:
                    pass
            else:
                graph, _ = _dealt(batches)
            root = _components_of(graph)
            linked = np.diff(graph.starts) > 0  # names may hold more than the ends of pairs
            linked[graph.ends] = True
            linked = np.flatnonzero(linked)
            for lo in range(0, len(linked), 20_000):
                part = linked[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([graph.names.take(pa.array(part)).cast(pa.string()), graph.names.take(pa.array(root[part])).cast(pa.string())], names=["i", "c"])

        one = spark.range(0, 1, 1, 1) if arrays is not None else cut(blocks).coalesce(1)
        found = one.mapInArrow(work, "i string, c string")
        if nodes is None:
            return found.select(F.col("i").alias("id"), F.col("c").alias("component"))
        return nodes.join(found, nodes["id"] == found["i"], "left").select("id", F.coalesce("c", "id").alias("component"))
    pairs = spelled(pairs, names)
    nodes = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")) if nodes is None else nodes
    left = cut(nodes.select("id").distinct())
    open_ = cut(pairs.where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        label = cut(left.select("id", F.col("id").alias("top")))
        while True:
            told = open_.join(label, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("i")).agg(F.max("top").alias("m"))
            after = cut(label.join(told, F.col("id") == F.col("i"), "left").select("id", F.greatest("top", F.coalesce("m", "top")).alias("top")))
            same = after.join(label, ["id", "top"], "left_anti").isEmpty()
            label = after
            if same:
                break
        inside = open_.join(label.select(F.col("id").alias("src"), F.col("top").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("top").alias("b")), "dst").where("a = b")
        back = search(label.where("id = top").select(F.col("id").alias("qid"), "id"), adjacency(inside.select("src", "dst"), reverse=True))
        found = cut(back.join(back.groupBy("qid").agg(F.min("id").alias("component")), "qid").select("id", "component"))
        done = found if done is None else cut(done.unionByName(found))
        left = cut(left.join(found, "id", "left_anti"))
        gone = found.select("id")
        open_ = cut(open_.join(gone, open_["src"] == gone["id"], "left_anti").join(gone, open_["dst"] == gone["id"], "left_anti"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def layering(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component, column): the longest path to a component in the condensation of the graph."""
    comp = cut(strong_components(nodes, pairs))
    a, b = comp.select(F.col("id").alias("src"), F.col("component").alias("ca")), comp.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    arcs = cut(pairs.join(a, "src").join(b, "dst").where("ca <> cb").select("ca", "cb").distinct())
    depth = cut(comp.select(F.col("component").alias("c")).distinct().withColumn("d", F.lit(0)))
    while True:
        pushed = depth.join(arcs, F.col("c") == F.col("ca")).groupBy(F.col("cb").alias("c")).agg((F.max("d") + 1).alias("e"))
        after = cut(depth.join(pushed, "c", "left").select("c", F.greatest("d", F.coalesce("e", F.lit(0))).alias("d")))
        if not after.join(depth, ["c", "d"], "left_anti").isEmpty():
            depth = after
            continue
        return comp.join(after, comp["component"] == after["c"]).select("id", "component", F.col("d").alias("column"))


def boundary_search(
    starts: DataFrame, edges: DataFrame, inner: tuple[str, ...] = ("import",), max_depth: int | None = None, chains: bool = True, names: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, depth, chain) of what starts(qid, id) reach by at least one edge whose type is not ``inner``: the shortest such chain.

    A state is a node and whether a boundary has been crossed; the start is not met again. With names(key, id) the ends of edges are whole
    numbers; see `search`.
    """
    state = lambda c, flag: F.concat(F.col(c), F.lit("\x01" + flag))
    spelt, plain = state, F.col("type").isin(*inner)
    if names is not None:
        names = names.select(F.explode(F.array(*[F.struct((2 * F.col("key") + int(f)).alias("key"), spelt("id", f).alias("id")) for f in "01"])).alias("s")).select("s.*")
        state = lambda c, flag: 2 * F.col(c) + int(flag)
    steps = edges.select(
        F.explode(F.array(F.struct(state("src", "0").alias("src"), F.when(plain, state("dst", "0")).otherwise(state("dst", "1")).alias("dst")), F.struct(state("src", "1").alias("src"), state("dst", "1").alias("dst")))).alias("e")
    ).select("e.*")
    found = search(starts.select("qid", spelt("id", "0").alias("id")), steps, max_depth, avoid=starts.select("qid", spelt("id", "1").alias("id")), chains=chains, names=names)
    chain = [F.transform("chain", lambda x: F.substring_index(x, "\x01", 1)).alias("chain")] if chains else []
    return found.where(F.col("id").endswith("1")).select("qid", F.substring_index("id", "\x01", 1).alias("id"), "depth", *chain)


def all_cycles(edges: DataFrame) -> DataFrame:
    """(step, cycle) of every edge that goes back to an open node in a depth-first search over sorted nodes: the chain that it closes.

    The order of a depth-first search is not relational, so the graph goes to one task; it must be small enough to be broadcast.
    """
    arrays = Arrays.of(cut(edges.select("src", "dst")))
    if arrays is None:
        raise ValueError("cycles are listed of graphs that one task can hold; see strong_components for others")
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast(arrays)

    def work(batches):
        import pyarrow as pa

        for _ in batches:
            graph, out = sent.value, []
            names, at, ends = graph.names.to_pylist(), graph.starts.tolist(), graph.ends.tolist()
            where, state, path = {}, [0] * len(names), []
            for first in range(len(names)):
                if state[first]:
                    continue
                path.append([first, at[first]])
                state[first], where[first] = 1, 0
                while path:
                    node, edge = path[-1]
                    if edge == at[node + 1]:
                        state[node] = 2
                        path.pop()
                        continue
                    path[-1][1] += 1
                    to = ends[edge]
                    if state[to] == 1:
                        out.append([names[x] for x, _ in path[where[to] :]] + [names[to]])
                    elif not state[to]:
                        state[to], where[to] = 1, len(path)
                        path.append([to, at[to]])
            yield pa.RecordBatch.from_arrays([pa.array(range(1, len(out) + 1), pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["step", "cycle"])

    return spark.range(0, 1, 1, 1).mapInArrow(work, "step long, cycle array<string>")


def first_cycle(edges: DataFrame) -> DataFrame:
    """(step, id) of the first cycle that a depth-first search over sorted nodes meets; no rows without one."""
    return all_cycles(edges).where("step = 1").select(F.posexplode("cycle").alias("step", "id"))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """rows with ``kept``: in order, each that still fits its group's budget; one that does not is skipped and the next tried.

    That is no prefix of a running sum, so a group is folded as an array of sizes in the JVM.
    """
    sizes = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)[order]}>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["kept"], F.array(x["o"])).alias("kept"))).otherwise(a)
    kept = sizes.select(F.col(group).alias("__g"), F.explode(F.aggregate("all", start, step)["kept"]).alias("__o"), F.lit(True).alias("__k"))
    return rows.join(kept, (F.col(group) == F.col("__g")) & (F.col(order) == F.col("__o")), "left").withColumn("kept", F.coalesce("__k", F.lit(False))).drop("__g", "__o", "__k")
