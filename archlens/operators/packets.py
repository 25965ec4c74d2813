"""Whole answers: a batch of questions of every kind in one dataflow, each ending in a packet of bounded size.

1. ``bound``: which graph, operation and nodes a question means. Names alone decide first; then the scorer ranks the ends of all
   questions that are left, of both readings, in one batch.
2. ``reached``: one search forward and one backward for all questions about files and groups, and the same over calls.
3. ``assembled``: rows in the order of the search, as many as fit the caps on nodes, witnesses and bytes; whole chains only, never a
   cut one; where rows are left a continuation says where to go on.

Rows of a question are cut to a page by rank before anything is collected, so that no group holds more than a packet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, ranking, scoring

# What a packet holds at most.
NODES, EDGES, WITNESSES, REFS, ALTERNATIVES, PACKET_BYTES = 200, 400, 200, 200, 20, 1 << 20
TIERS = ("resolved", "instance-local", "typed", "through-decorator")
STATIC = "Static source relationships, not runtime behaviour."
DEPENDENTS = "Dependents are potentially affected via static imports, not guaranteed to break."
CALLS = "Static calls, not runtime execution; calls that are not resolved are unknown."
SCORED = "evidence of the scorer"
BACKWARD, PAIRED = ("DOWNSTREAM", "CALLERS"), ("PATH", "FLOW")
STRINGS = "array<string>"


def _none(kind: str = STRINGS):
    return F.array().cast(kind)


def _ends(first, second):
    """An array of (place, text) of the ends that there are."""
    both = F.array(*[F.struct(F.lit(i).alias("place"), c.alias("text")) for i, c in enumerate((first, second))])
    return F.filter(both, lambda e: e["text"].isNotNull())


def _by_place(value, name: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda x: x["v"]).alias(name)


def bound(questions: DataFrame, index: DataFrame, symbols: DataFrame, aliases: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """(qid, plane, op, state, ids, alternatives, missing, reason) of questions(qid, question).

    state: bound (ids: a node for each end), needs-choice (alternatives), no-match or unsupported; plane: files or symbols. missing: an
    extension or folder was named that is not there. index as `scoring.indexed` gives it; symbols(id, name, qualname, path).
    """
    names = graph.wide(graph.cut(scoring.symbol_names(symbols)))
    told = graph.cut(scoring.resolved(questions, index, symbols, aliases))
    asked = scoring.requests(questions, index, names)
    rest = graph.cut(asked.join(told.where("outcome <> 'scored'").select("qid"), "qid", "left_anti").withColumn("hint", T.kind_hint(F.col("question"))))
    lost = (F.col("i.op") == "PATH") & F.col("i.from").isNull()

    # What the question names if it is about definitions, each name with the definitions of that name.
    guess = F.when(F.col("s").isNull(), T.filename_text(F.col("normal")))
    said = rest.select("qid", "hint", guess.isNotNull().alias("guessed"), F.explode(_ends(F.coalesce("s.first", guess), F.col("s.second"))).alias("e"))
    said = said.select("qid", "hint", "guessed", "e.place", F.col("e.text").alias("name"), T.filename_text(F.regexp_replace("e.text", r"^the\s+", "")).alias("short"))
    ids = names.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    met = said.join(ids.select(F.col("key").alias("name"), F.col("ids").alias("own")), "name", "left").join(ids.select(F.col("key").alias("short"), F.col("ids").alias("cut")), "short", "left")
    met = met.withColumn("text", F.when(F.col("own").isNotNull(), F.col("name")).otherwise(F.col("short"))).withColumn("ids", F.coalesce("own", "cut", _none()))
    said = graph.cut(met.where("not guessed or size(ids) > 0").select("qid", "hint", "guessed", "place", "text", "ids"))

    # The scorer ranks every end once: as files and groups, as definitions' names, and ends that names alone left open.
    key = lambda role: F.struct("qid", F.lit(role).alias("role"), "place").alias("qid")
    path = F.col("i.op") == "PATH"
    intents = rest.where(~lost).select("qid", F.explode(_ends(F.when(path, F.col("i.from")).otherwise(F.col("i.target")), F.when(path, F.col("i.to")))).alias("e")).select("qid", "e.*")
    open_ = told.where("outcome = 'unresolved'").select("qid", F.explode("ends").alias("e")).select("qid", "e.*").where("size(ids) = 0")
    texts = reduce(DataFrame.unionByName, [df.select(key(role), "text") for role, df in (("intent", intents), ("said", said), ("open", open_))])
    texts = graph.cut(texts)
    heads = graph.cut(scoring.heads(texts, graph.cut(scoring.rank(texts, index, aliases, prior))).select("qid.qid", "qid.role", "qid.place", "label", "yes", "choice", "tier", "missing", "suggestions"))

    head = F.struct("yes", "choice", "missing", "suggestions")
    poor = (F.col("label") == "No match") | (F.col("tier") == "fuzzy")
    as_intent = heads.where("role = 'intent'").groupBy("qid").agg(F.min(poor).alias("all_poor"), _by_place(head, "i_heads"))
    node = index.select(F.explode(F.array_distinct(F.array("id", F.coalesce("path", F.lit("")), "label"))).alias("text")).where("text <> ''").distinct().withColumn("is_node", F.lit(True))
    named = said.join(heads.where("role = 'said'").drop("role"), ["qid", "place"]).join(node, "text", "left")
    looked = F.size("ids") > 0
    other = F.coalesce("is_node", F.lit(False)) | ((~looked | F.coalesce(F.col("hint").isin("file", "layer"), F.lit(False))) & ~poor & ~F.col("missing"))
    as_said = named.groupBy("qid").agg(F.max(looked).alias("some"), F.min(looked).alias("every_"), F.max(other).alias("other"), F.max("guessed").alias("guessed"), _by_place(F.col("ids"), "s_ids"), _by_place(head, "s_heads"))

    rows = rest.join(as_intent, "qid", "left").join(as_said, "qid", "left")
    taken = F.coalesce("guessed", F.lit(False)) & ((F.coalesce("hint", F.lit("")) == "symbol") | F.coalesce("all_poor", F.lit(True)))
    s_op = F.coalesce(F.col("s.op"), F.when(taken, "LOCATE"))
    rows = rows.withColumn("s_op", s_op)
    locate = F.col("s_op") == "LOCATE"
    prefers = (F.coalesce("hint", F.lit("")) == "symbol") & (~locate | F.coalesce("every_", F.lit(False)))
    legacy = F.col("s_op").isNotNull() & ~prefers & F.coalesce("other", F.lit(False))
    rows = rows.withColumn("legacy", legacy).withColumn("by_calls", F.col("s_op").isNotNull() & ~legacy & (~locate | F.coalesce("some", F.lit(False))))

    calls = rows.where("by_calls").withColumn("state", F.when(F.exists("s_ids", lambda x: F.size(x) == 0), "no-match").when(F.exists("s_ids", lambda x: F.size(x) > 1), "needs-choice").otherwise("bound"))
    many = F.get(F.filter("s_ids", lambda x: F.size(x) > 1), F.lit(0))
    first = lambda c: F.transform(c, lambda x: F.get(x, F.lit(0)))
    parts = [_shaped(calls, "symbols", F.col("s_op"), F.col("state"), first("s_ids"), many, F.lit(False), F.lit("definitions of that name"))]

    files = rows.where("not by_calls").withColumn("mapped", F.col("legacy") & (F.coalesce("s_op", F.lit("")) != "LOCATE"))
    op = F.when(F.col("mapped"), F.coalesce(*[F.when(F.col("s_op") == k, v) for k, v in scoring.FOR_FILES.items()], F.col("s_op"))).otherwise(F.col("i.op"))
    files = files.withColumn("heads", F.when(F.col("mapped"), F.col("s_heads")).otherwise(F.col("i_heads"))).withColumn("op2", op)
    yes = F.coalesce(F.forall("heads", lambda h: h["yes"]), F.lit(False)) & (F.col("mapped") | ~lost)
    offered = F.array_distinct(F.flatten(F.transform("heads", lambda h: h["suggestions"])))
    offered = F.when(yes, _none()).otherwise(F.coalesce(offered, _none()))
    state = F.when(yes, "bound").when(F.size(offered) > 0, "needs-choice").otherwise("no-match")
    missing = F.coalesce(F.exists("heads", lambda h: h["missing"]), lost)
    parts.append(_shaped(files, "files", F.col("op2"), state, F.transform("heads", lambda h: h["choice"]), offered, missing, F.lit(SCORED)))

    # Names alone: as they were told, and what they left open with the scorer's word for it.
    plain = told.where("outcome in ('needs-choice', 'unsupported', 'symbols', 'files')")
    plane = F.when(F.col("outcome") == "symbols", "symbols").otherwise("files")
    how = F.when(F.col("outcome").isin("symbols", "files"), "bound").otherwise(F.col("outcome"))
    op = F.when(F.col("outcome") == "files", F.col("file_op")).otherwise(F.col("op"))
    parts.append(_shaped(plain, plane, op, how, F.col("ids"), F.when(F.col("outcome") == "needs-choice", F.col("ids")), F.lit(False), F.lit("literal names")))
    filled = told.where("outcome = 'unresolved'").select("qid", "op", "file_op", F.explode("ends").alias("e")).select("qid", "op", "file_op", "e.place", "e.ids")
    filled = filled.join(heads.where("role = 'open'").select("qid", "place", "yes", "choice", "suggestions"), ["qid", "place"], "left")
    got = F.coalesce(F.get("ids", F.lit(0)), F.when(F.col("yes"), F.col("choice")))
    unsure = F.when(got.isNull(), F.coalesce("suggestions", _none())).otherwise(_none())
    filled = filled.withColumn("got", got).withColumn("unsure", unsure).join(symbols.select(F.col("id").alias("got"), F.lit(1).alias("sym")).distinct(), "got", "left")
    filled = filled.groupBy("qid", "op", "file_op").agg(_by_place(F.col("got"), "ids"), _by_place(F.col("unsure"), "unsure"), F.max(F.coalesce("sym", F.lit(0))).alias("a"), F.min(F.coalesce("sym", F.lit(0))).alias("b"))
    offered = F.coalesce(F.get(F.filter("unsure", lambda x: F.size(x) > 0), F.lit(0)), _none())
    state = F.when(F.size(offered) > 0, "needs-choice").when(F.exists("ids", lambda x: x.isNull()), "no-match").when(F.col("a") != F.col("b"), "unsupported").otherwise("bound")
    plane, op = F.when(F.col("a") == 1, "symbols").otherwise("files"), F.when(F.col("a") == 1, F.col("op")).otherwise(F.col("file_op"))
    parts.append(_shaped(filled, plane, op, state, F.col("ids"), offered, F.lit(False), F.lit("literal names and the scorer")))
    return reduce(DataFrame.unionByName, parts)


def _shaped(rows: DataFrame, plane, op, state, ids, alternatives, missing, reason) -> DataFrame:
    plane = F.lit(plane) if isinstance(plane, str) else plane
    rows = rows.select("qid", plane.alias("plane"), op.alias("op"), state.alias("state"), ids.alias("ids"), alternatives.alias("alternatives"), missing.alias("missing"), reason.alias("reason"))
    keep = lambda state, c: F.when(F.col("state") == state, F.coalesce(F.col(c), _none())).otherwise(_none()).alias(c)
    return rows.select("qid", "plane", "op", "state", keep("bound", "ids"), keep("needs-choice", "alternatives"), "missing", "reason")


def stepped(starts: DataFrame, pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(qid, id, depth, chain) of what starts(qid, id) reach by one of pairs(src, dst), but other starts of theirs: what `graph.search` finds
    in one step, by joins alone, since of a large graph only a few pairs are needed. See there for names."""
    starts, send = _counted(starts.where("id is not null").select("qid", "id").distinct())
    if names is None:
        keyed = starts.select("qid", F.col("id").alias("start"), F.col("id").alias("src"))
    else:
        keyed = names.join(send(starts), "id").select("qid", F.col("id").alias("start"), F.col("key").alias("src"))
    keyed, send = _counted(keyed)
    met = pairs.join(send(keyed), "src").select("qid", "start", F.col("dst").alias("key")).distinct()
    if names is None:
        met = met.withColumnRenamed("key", "id")
    else:
        met, send = _counted(met)
        met = names.join(send(met), "key").select("qid", "start", "id")
    found = met.groupBy("qid", "id").agg(F.min(F.array("start", "id")).alias("chain")).join(starts, ["qid", "id"], "left_anti")
    return found.select("qid", "id", F.lit(1).alias("depth"), "chain")


def _counted(rows: DataFrame) -> tuple:
    """rows, cut, and how frames of as many rows are joined: by broadcast if they are few."""
    rows = graph.cut(rows)
    few = rows.count() <= graph.WIDE_ROWS
    return rows, lambda df: F.broadcast(df) if few else df.hint("merge")


def among(wanted: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """edges between the ends of wanted(src, dst), each by their ids; see `graph.search` for names."""
    wanted, send = _counted(wanted.where("src is not null and dst is not null").select("src", "dst").distinct())
    if names is None:
        return edges.join(send(wanted), ["src", "dst"], "left_semi")
    ends, send_ends = _counted(names.join(send(wanted.select(F.explode(F.array("src", "dst")).alias("id")).distinct()), "id").select("id", "key"))
    a, b = (ends.select(F.col("id").alias(e), F.col("key").alias(f"{e}_key")) for e in ("src", "dst"))
    keyed, send = _counted(wanted.join(send_ends(a), "src").join(send_ends(b), "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.withColumnsRenamed({"src": "src_key", "dst": "dst_key"}).join(send(keyed), ["src_key", "dst_key"]).select("src", "dst", *rest)


def reached(asked: DataFrame, edges: DataFrame, back: tuple[str, ...], one_hop: tuple[str, ...] = (), members: DataFrame | None = None, names: DataFrame | None = None, most: int = NODES) -> DataFrame:
    """(qid, id, depth, chain, n, total) of bound questions asked(qid, op, ids) over edges(src, dst): chain from a start to what it leads to;
    of each question the first ``most`` in order of depth and chain, numbered from 1, and the number of all.

    Operations in ``back`` go against the edges, those in ``one_hop`` one step only; of a pair of ends the shortest chain alone. members(layer,
    id): a group stands for its files, as start and as target, and its own files are not results. See `graph.search` for names.
    """

    def ends(rows: DataFrame, place: int) -> DataFrame:
        rows = rows.select("qid", F.get("ids", F.lit(place)).alias("id"))
        if members is None:
            return rows
        inner = members.select(F.col("layer").alias("id"), F.col("id").alias("inner"))
        return rows.join(inner, "id", "left").select("qid", F.coalesce("inner", "id").alias("id"))

    moving = asked.where("op <> 'LOCATE'")
    goes_back, short, pair = F.col("op").isin(*back), F.col("op").isin(*one_hop), F.col("op").isin(*PAIRED)
    few = [moving.where("false").select("qid", F.get("ids", F.lit(0)).alias("id"), F.lit(0).alias("depth"), F.col("ids").alias("chain"))]
    if one_hop:
        for reverse, which in ((False, short & ~goes_back), (True, short & goes_back)):
            few.append(stepped(ends(moving.where(which), 0), graph.adjacency(edges, reverse), names))
    found = []
    # A graph is not made for no question, and of what a question reaches only the rows that a packet may hold leave the task.
    for reverse, which in ((False, ~goes_back & ~short & ~pair), (True, goes_back & ~short)):
        first = graph.cut(ends(moving.where(which), 0))
        if not first.isEmpty():
            found.append(graph.first_reached(first, graph.adjacency(edges, reverse), most, names=names))
    first = graph.cut(ends(moving.where(pair & ~short & ~goes_back), 0))
    if not first.isEmpty():
        met = graph.search(first, graph.adjacency(edges), targets=graph.cut(ends(moving.where(pair), 1)), met=True, names=names)
        few.append(met.groupBy("qid").agg(F.min(F.struct("depth", "chain", "id")).alias("b")).select("qid", "b.id", "b.depth", "b.chain"))
    return reduce(DataFrame.unionByName, [ranked(reduce(DataFrame.unionByName, few)).where(F.col("n") <= most), *found])


def ranked(found: DataFrame) -> DataFrame:
    """found(qid, id, depth, chain) with n and total as `reached` gives them."""
    own = Window.partitionBy("qid")
    return found.withColumn("n", F.row_number().over(own.orderBy("depth", "chain")).cast("long")).withColumn("total", F.count("*").over(own))


def paged(found: DataFrame, asked: DataFrame, symbols: bool) -> DataFrame:
    """(qid, rows, total, next, bytes): the rows (n, id, chain, fresh) of each question that one packet holds, from its offset on.

    found as of `reached`; asked(qid, seed, offset, single): single, a group's start is no node of the chain, so a row adds its end only.
    A row brings the nodes of its chain that no row before it brought; rows go in as long as nodes, witnesses and bytes allow.
    """
    totals = found.groupBy("qid").agg(F.max("total").alias("total"))
    rows = graph.cut(found.drop("total").withColumn("n", F.col("n").cast("int")).join(asked.select("qid", "seed", "offset", "single"), "qid").where("n > offset and n <= offset + %d" % NODES))
    new = F.when(F.col("single"), F.array("id")).otherwise(F.filter("chain", lambda c: c != F.col("seed")))
    brought = rows.select("qid", "n", F.posexplode(new).alias("pos", "node")).groupBy("qid", "node").agg(F.min(F.struct("n", "pos")).alias("f"))
    brought = brought.groupBy("qid", F.col("f.n").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("f.pos").alias("pos"), "node"))).alias("fresh"))
    rows = rows.join(brought, ["qid", "n"], "left").withColumn("fresh", F.coalesce(F.transform("fresh", lambda x: x["node"]), _none()))
    run = Window.partitionBy("qid").orderBy("n")
    # The bytes of a witness as JSON: its nodes and for each hop both ends again.
    weight = 3 * F.aggregate("chain", F.lit(0), lambda a, c: a + F.octet_length(c) + 12)
    rows = rows.withColumn("used", 1 + F.sum(F.size("fresh")).over(run)).withColumn("bytes", F.sum(weight).over(run)).withColumn("count", F.count("*").over(run))
    kept = rows.where((F.col("used") <= NODES) & (F.col("bytes") <= PACKET_BYTES // 2) & (F.col("count") <= WITNESSES))
    told = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "id", "chain", "fresh"))).alias("rows"), F.max("n").alias("last"))
    return totals.join(told, "qid", "left").withColumn("next", F.when(F.coalesce("last", F.lit(0)) < F.col("total"), F.col("last")))


def _hops(w):
    """The hops (src, dst) of a chain of one node or more."""
    return F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("src"), F.slice(w, 2, F.size(w) - 1).alias("dst"))


def typed_hops(rows: DataFrame, edges: DataFrame, type_: str) -> DataFrame:
    """(qid, edges) of rows(qid, witnesses, selected): each hop once with its type, in the order of the witnesses; EDGES at most."""
    hops = rows.select("qid", "selected", F.posexplode(F.flatten(F.transform(F.filter("witnesses", lambda w: F.size(w) > 1), _hops))).alias("n", "h"))
    hops = hops.where(F.array_contains("selected", F.col("h.src")) & F.array_contains("selected", F.col("h.dst"))).groupBy("qid", "h.src", "h.dst").agg(F.min("n").alias("n"))
    kinds = edges.groupBy("src", "dst").agg(F.min(type_).alias("type"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("n", "src", "dst", "type"))), 1, EDGES)
    return hops.join(kinds, ["src", "dst"]).groupBy("qid").agg(F.transform(listed, lambda x: F.struct(x["src"], x["dst"], x["type"])).alias("edges"), (F.count("*") > EDGES).alias("many"))


def answer_packets(
    questions: DataFrame, index: DataFrame, edges: DataFrame, symbols: DataFrame, calls: DataFrame, aliases: DataFrame | None = None, prior: DataFrame | None = None,
    search_text: DataFrame | None = None, inventory: DataFrame | None = None, members: DataFrame | None = None, certain: bool = False,
    names: DataFrame | None = None, call_names: DataFrame | None = None,
) -> DataFrame:
    """A packet for each of questions(qid, question[, offset]): request_id, operation (NOT_SURE where the scorer cannot tell), requested (what
    was asked for all the same), status, highlight, seed, selected, edges, witnesses,
    alternatives, limitations, truncated, continuation, refs, confidence (of each witness about calls, its weakest call) and reason.

    index: `scoring.indexed` nodes; edges(src, dst, type) between files and between groups; calls(src, dst, confidence); members(layer, id,
    kind, ord): what lies in a folder, where groups are folders; inventory(path, sha256); search_text as `ranking.bm25` reads it. A question
    repeated under another qid is answered again; rows that repeat a qid are not expected. ``certain``: resolved calls only. With
    names(key, id) the ends of edges are keys, with call_names those of calls; see `graph.search`.
    """
    asked = questions.withColumn("offset", F.coalesce(F.col("offset").cast("int"), F.lit(0)) if "offset" in questions.columns else F.lit(0)).select("qid", "question", "offset")
    rows = bound(asked, index, symbols, aliases, prior)
    kinds = index.select("id", "kind").unionByName(symbols.select("id", F.lit("symbol").alias("kind"))).distinct()
    kinds = graph.wide(graph.cut(kinds))
    first, second = (kinds.select(F.col("id").alias(n), F.col("kind").alias(f"k_{n}")) for n in ("seed", "end"))
    rows = rows.withColumn("seed", F.get("ids", F.lit(0))).withColumn("end", F.get("ids", F.lit(1))).join(first, "seed", "left").join(second, "end", "left")
    mixed = (F.col("state") == "bound") & F.col("end").isNotNull() & (F.col("k_seed") != F.col("k_end"))
    rows = rows.withColumn("state", F.when(mixed, "unsupported").otherwise(F.col("state")))
    if search_text is not None:
        rows = _with_concepts(rows, asked, search_text)
    folders = F.lit(members is not None) & (F.col("k_seed") == "layer")
    rows = graph.cut(rows.join(asked.select("qid", "offset"), "qid").withColumn("single", F.coalesce(folders, F.lit(False))))

    used = calls.where("confidence = 'resolved'") if certain else calls
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("confidence"))
    used = used.where("src is not null and dst is not null").select("src", "dst", tier.cast("int").alias("tier"))
    if call_names is None:  # numbers are cheap to read again, and most are not needed
        used = graph.cut(used.groupBy("src", "dst").agg(F.max("tier").alias("tier")))
    moving = edges.where(~F.col("type").isin(*graph.IGNORED))
    go = rows.where("state = 'bound'")
    inner = None if members is None else members.where("kind = 'file'").select("layer", "id")
    most = (go.agg(F.max("offset")).first()[0] or 0) + NODES
    found = reached(go.where("plane = 'files'"), moving, BACKWARD, members=inner, names=names, most=most)
    found = found.unionByName(reached(go.where("plane = 'symbols'"), used, BACKWARD, ("CALLERS", "CALLEES"), names=call_names, most=most).select(*found.columns))
    if members is not None:
        # A folder that is located lists what lies in it, folders first, by pages.
        listed = go.where("op = 'LOCATE' and single").select("qid", F.col("seed").alias("layer")).join(members, "layer")
        listed = ranked(listed.select("qid", "id", F.col("ord").cast("int").alias("depth"), F.array("id").alias("chain")))
        found = found.unionByName(listed.where(F.col("n") <= most))
    pages = paged(graph.cut(found), go, symbols=False)
    return assembled(rows, pages, moving, used, index, inventory, names, call_names)


def _with_concepts(rows: DataFrame, asked: DataFrame, search_text: DataFrame) -> DataFrame:
    """Candidates by text for places that nothing else matched; they are offered, never taken."""
    rows = graph.cut(rows)
    open_ = rows.where("plane = 'files' and op = 'LOCATE' and state = 'no-match' and not missing").select("qid")
    hits = ranking.bm25(search_text, asked.join(open_, "qid", "left_semi").select("qid", "question"))
    offers = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")).alias("offers"))
    rows = rows.join(offers, "qid", "left")
    return rows.withColumn("state", F.when(F.col("offers").isNotNull(), "needs-choice").otherwise(F.col("state"))).withColumn("alternatives", F.coalesce("offers", "alternatives")).drop("offers")


def assembled(
    rows: DataFrame, pages: DataFrame, edges: DataFrame, calls: DataFrame, index: DataFrame, inventory: DataFrame | None, names: DataFrame | None = None, call_names: DataFrame | None = None,
) -> DataFrame:
    """Packets of bound rows and their pages; see `answer_packets` for names."""
    rows = rows.join(pages, "qid", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<n:int,id:string,chain:array<string>,fresh:array<string>>>")))
    bound_, pair, back = F.col("state") == "bound", F.col("op").isin(*PAIRED), F.col("op").isin(*BACKWARD)
    listing = (F.col("op") == "LOCATE") & F.col("single")
    no_path = bound_ & pair & F.col("total").isNull()
    too_long = bound_ & F.col("total").isNotNull() & (F.size("rows") == 0) & (F.col("offset") < F.coalesce("total", F.lit(0)))
    status = F.when(too_long, "unsupported").when(no_path, "no-path").when(bound_, "matched").otherwise(F.col("state"))
    rows = rows.withColumn("status", status)
    shown = F.col("status").isin("matched", "no-path")
    # Each node has its own witness; a page that starts later also brings the nodes between, each with its part of the chain.
    own = lambda r: F.when(F.col("plane") == "symbols", F.array(r["chain"])).otherwise(F.transform(r["fresh"], lambda x: F.slice(r["chain"], 1, F.array_position(r["chain"], x).cast("int"))))
    single = lambda r: F.array(r["chain"])
    walked = F.when(F.col("single") | pair, F.flatten(F.transform("rows", single))).otherwise(F.flatten(F.transform("rows", own)))
    walked = F.when(listing, _none("array<array<string>>")).otherwise(F.filter(walked, lambda w: (F.size(w) > 1) | (pair & F.col("single"))))
    rows = rows.withColumn("witnesses", F.when(shown, F.transform(walked, lambda w: F.when(back, F.reverse(w)).otherwise(w))).otherwise(_none("array<array<string>>")))
    fresh = F.flatten(F.transform("rows", lambda r: r["fresh"]))
    route = F.flatten(F.transform("rows", lambda r: r["chain"]))
    picked = F.when(pair & (F.size("rows") > 0), route).when(pair, F.array("seed", "end")).otherwise(F.concat(F.array("seed"), fresh))
    rows = graph.cut(rows.withColumn("selected", F.when(shown, F.array_distinct(picked)).otherwise(_none())))

    # Of edges and calls only those along a witness, and calls of itself, are needed from here on.
    along = rows.select("plane", F.explode(F.flatten(F.transform(F.filter("witnesses", lambda w: F.size(w) > 1), _hops))).alias("h")).select("plane", "h.*")
    selves = rows.where("plane = 'symbols'").select(F.col("seed").alias("src"), F.col("seed").alias("dst"))
    edges = graph.cut(among(along.where("plane = 'files'"), edges, names).groupBy("src", "dst").agg(F.min("type").alias("type")))
    calls = graph.cut(among(along.where("plane = 'symbols'").select("src", "dst").unionByName(selves), calls, call_names).groupBy("src", "dst").agg(F.max("tier").alias("tier")))
    hops = typed_hops(rows.where("plane = 'files'"), edges, "type")
    name = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier"))
    named = calls.withColumn("type", name)
    loops = rows.where("plane = 'symbols' and status = 'matched' and op not in ('LOCATE', 'PATH', 'FLOW')").select("qid", F.col("seed").alias("src")).join(named.where("src = dst"), "src")
    loops = loops.select("qid", F.array(F.struct("src", "dst", "type")).alias("loop"))
    by_call = typed_hops(rows.where("plane = 'symbols'"), named, "type")
    out = rows.join(hops.unionByName(by_call), "qid", "left").join(loops, "qid", "left")
    kind = "array<struct<src:string,dst:string,type:string>>"
    out = out.withColumn("edges", F.slice(F.concat(F.coalesce("edges", _none(kind)), F.coalesce("loop", _none(kind))), 1, EDGES))

    worst = rows.where("plane = 'symbols'").select("qid", F.posexplode("witnesses").alias("w", "chain"))
    pairs = worst.select("qid", "w", F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("src"), F.slice("chain", 2, F.size("chain") - 1).alias("dst"))).alias("h")).select("qid", "w", "h.*")
    worst = pairs.join(calls, ["src", "dst"]).groupBy("qid", "w").agg(F.max("tier").alias("tier")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "tier"))), lambda x: F.element_at(F.array(*map(F.lit, TIERS)), x["tier"])).alias("confidence"))
    out = out.join(worst, "qid", "left")

    if inventory is not None:
        paths = index.where("kind = 'file'").select("id", "path").join(inventory.select("path", "sha256"), "path")
        refs = rows.select("qid", F.posexplode("selected").alias("n", "id")).join(paths, "id").groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "path", "sha256"))), 1, REFS).alias("r"))
        out = out.join(refs.select("qid", F.transform("r", lambda x: F.struct(x["path"], x["sha256"])).alias("refs")), "qid", "left")
        out = out.withColumn("refs", F.coalesce("refs", _none("array<struct<path:string,sha256:string>>")))
    else:
        out = out.withColumn("refs", _none("array<struct<path:string,sha256:string>>"))
    matched, many = F.col("status") == "matched", F.size("alternatives") > F.col("offset") + ALTERNATIVES
    goes_on = (matched & F.col("next").isNotNull()) | ((F.col("status") == "needs-choice") & many)
    place = F.when(F.col("status") == "needs-choice", F.col("offset") + ALTERNATIVES).otherwise(F.col("next"))
    hit = matched & (F.col("op") == "DOWNSTREAM") & (F.size("witnesses") > 0) & (F.col("plane") == "files") & ~F.col("single")
    notes = F.array_compact(F.array(F.lit(STATIC), F.when(F.col("plane") == "symbols", F.lit(CALLS)), F.when(hit, F.lit(DEPENDENTS)), F.when(F.col("many"), F.lit(f"Selected edges capped at {EDGES}."))))
    why = F.when(F.col("status") == "unsupported", F.when(F.col("rows").isNotNull() & (F.col("state") == "bound"), "complete evidence exceeds the packet").otherwise("ends of different kinds")).otherwise(F.col("reason"))
    total = F.when(F.col("total").isNotNull(), F.concat(F.lit(": "), F.col("total").cast("string"))).otherwise(F.lit(""))
    return out.select(
        F.col("qid").alias("request_id"), F.when(F.col("status").isin("matched", "no-path", "unsupported") | (F.col("reason") != SCORED), F.col("op")).otherwise("NOT_SURE").alias("operation"),
        F.col("op").alias("requested"), "status",
        F.when(hit, "potential-impact").otherwise("relevant").alias("highlight"), F.when(matched, F.col("seed")).alias("seed"), "selected", "edges", "witnesses",
        F.when(F.col("status") == "needs-choice", F.slice("alternatives", F.col("offset") + 1, F.lit(ALTERNATIVES))).otherwise(_none()).alias("alternatives"), notes.alias("limitations"),
        goes_on.alias("truncated"), F.when(goes_on, F.concat(F.lit("offset:"), place.cast("string"))).alias("continuation"), "refs", F.coalesce("confidence", _none()).alias("confidence"), F.concat(why, total).alias("reason"),
    )


def node_witnesses(packets_: DataFrame) -> DataFrame:
    """(request_id, id, witness) for each selected node but the seed: the chain that ends, or for what depends on the seed begins, with it.

    A chain between other ends than the seed is no witness of a node; of several the first counts.
    """
    rows = packets_.select("request_id", "seed", "selected", F.posexplode("witnesses").alias("n", "witness")).where(F.size("witness") > 0)
    first, last = F.element_at("witness", 1), F.element_at("witness", -1)
    other = F.when(first == F.col("seed"), last).when(last == F.col("seed"), first)
    rows = rows.withColumn("id", other).where(F.col("id").isNotNull() & F.array_contains("selected", F.col("id")) & ((F.col("id") != F.col("seed")) | (F.size("witness") == 1)))
    return rows.groupBy("request_id", "id").agg(F.min_by("witness", "n").alias("witness"))
