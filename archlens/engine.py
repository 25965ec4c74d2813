"""The verbs of the engine over the tables of one snapshot, DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, packets, ranking, scoring

#: Confidence of a call from strongest to weakest.
TIERS = ("resolved", "instance-local", "typed", "through-decorator")


class Engine:
    """nodes(id, kind, label, path, aliases, descr), edges(src, dst, type), and where there are any search_text(id, name, path,
    docstring), symbols(id, name, qualname, path), calls(src, dst, confidence), learned aliases(alias, node), prior(id, prior),
    inventory(path, sha256) and members(layer, id, kind, ord). Searches go on to the end where no max_depth is given."""

    def __init__(
        self, nodes: DataFrame, edges: DataFrame, search_text: DataFrame | None = None, symbols: DataFrame | None = None, calls: DataFrame | None = None, max_depth: int | None = None,
        aliases: DataFrame | None = None, prior: DataFrame | None = None, inventory: DataFrame | None = None, members: DataFrame | None = None,
    ):
        self.nodes, self.edges, self.search_text, self.symbols, self.calls, self.max_depth = nodes, edges, search_text, symbols, calls, max_depth
        self.aliases, self.prior, self.inventory, self.members, self.index = aliases, prior, inventory, members, None

    def parse(self, questions: DataFrame) -> DataFrame:
        """(qid, normal, op, target, from, to) of questions(qid, question)."""
        rows = questions.select("qid", T.normalize_question(F.col("question")).alias("normal"))
        return rows.select("qid", "normal", T.intent(F.col("normal")).alias("i")).select("qid", "normal", "i.*")

    def find_nodes(self, wanted: DataFrame) -> DataFrame:
        """(qid, id, tier) of wanted(qid, name): paths, else basenames, else stems, without regard to case; all that tie."""
        base = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
        keys = F.array(F.struct(F.lower("path").alias("key"), F.lit("path").alias("tier"), F.lit(0).alias("n")), F.struct(base.alias("key"), F.lit("basename").alias("tier"), F.lit(1).alias("n")), F.struct(F.regexp_replace(base, r"\.[^.]*$", "").alias("key"), F.lit("stem").alias("tier"), F.lit(2).alias("n")))
        index = self.nodes.where("path is not null").select("id", F.explode(keys).alias("k")).select("id", "k.*")
        met = wanted.select("qid", F.lower("name").alias("key")).join(index, "key")
        best = met.groupBy("qid").agg(F.min("n").alias("best"))
        return met.join(best, "qid").where("n = best").select("qid", "id", "tier").distinct()

    def dependencies(self, ids: DataFrame, depth: int | None = None) -> DataFrame:
        """(qid, id, depth, chain) of what ids(qid, id) depend on."""
        return graph.search(ids, graph.adjacency(self.edges), depth or self.max_depth).where("depth > 0")

    def dependents(self, ids: DataFrame, depth: int | None = None) -> DataFrame:
        """(qid, id, depth, chain) of what depends on ids; chains run from the consumer."""
        found = graph.search(ids, graph.adjacency(self.edges, reverse=True), depth or self.max_depth).where("depth > 0")
        return found.withColumn("chain", F.reverse("chain"))

    def find_path(self, pairs: DataFrame) -> DataFrame:
        """(qid, depth, chain) of pairs(qid, source, target): the shortest path, the first of several."""
        targets = pairs.select("qid", F.col("target").alias("id"))
        found = graph.search(pairs.select("qid", F.col("source").alias("id")), graph.adjacency(self.edges), self.max_depth, targets)
        return found.join(targets, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min(F.struct("depth", "chain")).alias("b")).select("qid", "b.*")

    def callers(self, ids: DataFrame, certain: bool = False) -> DataFrame:
        """(qid, id, confidence) one call away from ids."""
        calls = self.calls.where("confidence = 'resolved'") if certain else self.calls
        return ids.join(calls, ids["id"] == calls["dst"]).select("qid", F.col("src").alias("id"), "confidence")

    def callees(self, ids: DataFrame, certain: bool = False) -> DataFrame:
        calls = self.calls.where("confidence = 'resolved'") if certain else self.calls
        return ids.join(calls, ids["id"] == calls["src"]).select("qid", F.col("dst").alias("id"), "confidence")

    def trace(self, ids: DataFrame, certain: bool = False, reverse: bool = False) -> DataFrame:
        """(qid, id, depth, chain, tier) of all that calls of ids lead to, or of all that lead to them; tier: the weakest call of the chain.

        A call of a definition by itself is an edge, but leads nowhere new.
        """
        calls = graph.cut(self.ranked_calls(certain))
        found = graph.cut(graph.search(ids, graph.adjacency(calls.where("src <> dst"), reverse=reverse), self.max_depth).where("depth > 0"))
        return self.weakest(found, calls, reverse)

    def flow(self, pairs: DataFrame, certain: bool = False) -> DataFrame:
        """(qid, id, depth, chain, tier) of the shortest chain of calls of pairs(qid, source, target); none where there is none."""
        calls = graph.cut(self.ranked_calls(certain))
        targets = pairs.select("qid", F.col("target").alias("id"))
        found = graph.search(pairs.select("qid", F.col("source").alias("id")), calls.where("src <> dst").select("src", "dst"), self.max_depth, targets)
        return self.weakest(graph.cut(found.join(targets, ["qid", "id"], "left_semi")), calls)

    def ranked_calls(self, certain: bool) -> DataFrame:
        rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("confidence"))
        calls = self.calls.where("confidence = 'resolved'") if certain else self.calls
        return calls.groupBy("src", "dst").agg(F.max(rank).alias("tier"))

    @staticmethod
    def weakest(found: DataFrame, calls: DataFrame, reverse: bool = False) -> DataFrame:
        hop = lambda i: F.struct(F.element_at("chain", i).alias("a"), F.element_at("chain", i + 1).alias("b"))
        hops = found.where("depth > 0").select("qid", "id", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), hop)).alias("h")).select("qid", "id", "h.a", "h.b")
        a, b = ("dst", "src") if reverse else ("src", "dst")
        worst = hops.join(calls, (F.col("a") == F.col(a)) & (F.col("b") == F.col(b))).groupBy("qid", "id").agg(F.max("tier").alias("t"))
        told = found.join(worst, ["qid", "id"], "left")
        return told.select("qid", "id", "depth", F.reverse("chain").alias("chain") if reverse else "chain", F.element_at(F.array(*map(F.lit, TIERS)), F.col("t").cast("int")).alias("tier"))

    def answer_symbols(self, questions: DataFrame, certain: bool = False) -> DataFrame:
        """(qid, op, status, id, depth, chain, tier, alternatives) of questions about definitions; questions of another kind have no row.

        A name that several definitions have asks for a choice of at most twenty; one that none has is no match.
        """
        asked = questions.select("qid", T.symbol_request(T.normalize_question(F.col("question"))).alias("s")).where("s is not null").select("qid", "s.*")
        asked = graph.cut(asked)
        names = asked.select("qid", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("role"), F.col("first").alias("name")), F.struct(F.lit(1).alias("role"), F.col("second").alias("name"))), lambda x: x["name"].isNotNull())).alias("n")).select("qid", "n.*")
        met = names.withColumn("key", F.lower("name")).join(self.symbols.select("id", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("name")))).alias("key")), "key", "left")
        ends = met.groupBy("qid", "role").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        sides = ends.groupBy("qid").agg(F.max(F.when(F.col("role") == 0, F.col("ids"))).alias("a"), F.max(F.when(F.col("role") == 1, F.col("ids"))).alias("b"))
        rows = asked.join(sides, "qid").withColumn("least", F.least(F.size("a"), F.coalesce(F.when(F.col("op") == "FLOW", F.size("b")), F.size("a")))).withColumn("most", F.greatest(F.size("a"), F.coalesce(F.when(F.col("op") == "FLOW", F.size("b")), F.lit(0))))
        rows = graph.cut(rows.withColumn("state", F.when(F.col("least") == 0, "no-match").when(F.col("most") > 1, "needs-choice").otherwise("bound")))
        one = lambda *ops: rows.where(F.col("op").isin(*ops) & (F.col("state") == "bound")).select("qid", F.element_at("a", 1).alias("id"))
        near = lambda ids, back: (self.callers if back else self.callees)(ids, certain).select("qid", "id", F.lit(1).alias("depth"), F.array("id").alias("chain"), F.col("confidence").alias("tier"))
        located = one("LOCATE").select("qid", "id", F.lit(0).alias("depth"), F.array("id").alias("chain"), F.lit(None).cast("string").alias("tier"))
        pairs = rows.where("op = 'FLOW' and state = 'bound'").select("qid", F.element_at("a", 1).alias("source"), F.element_at("b", 1).alias("target"))
        found = located.unionByName(near(one("CALLERS"), True)).unionByName(near(one("CALLEES"), False)).unionByName(self.trace(one("TRACE"), certain)).unionByName(self.flow(pairs, certain))
        told = rows.join(found, "qid", "left")
        status = F.when(F.col("state") != "bound", F.col("state")).when((F.col("op") == "FLOW") & F.col("id").isNull(), "no-path").otherwise("matched")
        choice = F.when(F.col("state") == "needs-choice", F.array_join(F.slice(F.when(F.size("a") > 1, F.col("a")).otherwise(F.col("b")), 1, 20), ","))
        return told.select("qid", "op", status.alias("status"), "id", "depth", F.array_join("chain", ">").alias("chain"), "tier", choice.alias("alternatives"))

    def find_symbols(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("qid", F.lower("name").alias("key")).join(self.symbols.select("id", F.lower("name").alias("key")), "key").select("qid", "id")

    def concepts(self, questions: DataFrame) -> DataFrame:
        """Candidates by text; never an answer of their own."""
        return ranking.bm25(self.search_text, questions)

    def _described(self) -> DataFrame:
        """Nodes with all columns that the scorer reads; ``idx`` numbers them in the order of their ids where there is none."""
        nodes = self.nodes
        if "idx" not in nodes.columns:
            nodes = nodes.orderBy("id").withColumn("idx", F.monotonically_increasing_id())
        base = F.regexp_extract(F.coalesce("path", "id"), "([^/]*)$", 1)
        fill = {"label": base, "aliases": F.array().cast("array<string>"), "descr": F.lit("")}
        return nodes.withColumns({c: v for c, v in fill.items() if c not in nodes.columns})

    def answer_packets(self, questions: DataFrame, certain: bool = False) -> DataFrame:
        """Packets of questions(qid, question[, offset]) about files, groups and definitions alike; see `packets.answer_packets`."""
        if self.index is None:
            self.index = graph.cut(scoring.indexed(self._described()))
        spark = questions.sparkSession
        symbols = self.symbols if self.symbols is not None else spark.createDataFrame([], "id string, name string")
        for c in {"qualname", "path"} - set(symbols.columns):
            symbols = symbols.withColumn(c, F.lit(None).cast("string"))
        calls = self.calls if self.calls is not None else spark.createDataFrame([], "src string, dst string, confidence string")
        return packets.answer_packets(questions, self.index, self.edges, symbols, calls, self.aliases, self.prior, self.search_text, self.inventory, self.members, certain)

    def answer(self, questions: DataFrame) -> DataFrame:
        """(qid, op, status, target, id, depth, chain, alternatives): `answer_packets` as rows, one for each witness or located node, else one
        with the status alone."""
        told = graph.cut(self.answer_packets(questions))
        back = F.col("requested").isin(*packets.BACKWARD)
        end = lambda w: F.when(back, F.element_at(w, 1)).otherwise(F.element_at(w, -1))
        rows = F.transform(F.filter("witnesses", lambda w: F.size(w) > 0), lambda w: F.struct(end(w).alias("id"), (F.size(w) - 1).alias("depth"), F.array_join(w, ">").alias("chain")))
        located = F.transform("selected", lambda x: F.struct(x.alias("id"), F.lit(0).alias("depth"), x.alias("chain")))
        rows = F.when(F.col("requested") == "LOCATE", located).when(F.col("status") == "matched", rows)
        out = told.withColumn("r", F.explode_outer(rows))
        return out.select(
            F.col("request_id").alias("qid"), F.col("requested").alias("op"), "status", F.col("seed").alias("target"), "r.id", "r.depth", "r.chain",
            F.when(F.size("alternatives") > 0, F.array_join("alternatives", ",")).alias("alternatives"),
        )
