"""Integrity as queries: each check is rows (rule, what) that must be empty on good data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses, edge types, caps of a packet, tiers, findings.
STATUSES = ("matched", "needs-choice", "no-match", "no-path", "unsupported", "stale")
EDGE_TYPES = ("import", "http", "rpc", "manual", "realtime")
CAPS = {"nodes": 200, "edges": 400, "witnesses": 200, "alternatives": 20}


def rule(name: str, df: DataFrame, what) -> DataFrame:
    return df.select(F.lit(name).alias("rule"), (F.col(what) if isinstance(what, str) else what).cast("string").alias("what"))


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def twice(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(F.concat_ws(" ", *key).alias("key"))


DIGEST = "^[0-9a-f]{64}$"


def unsafe(path):
    """Whether a path is no literal relative one."""
    return (path == "") | path.rlike(r"[\x00-\x1f\\]|^[A-Za-z]:|^/") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def snapshot(nodes: DataFrame, edges: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Violations of nodes(id, kind, layer), edges(src, dst, type) and, where it is given, inventory(path, sha256, line_count)."""
    kinds = nodes.select("id", "kind").distinct()
    a, b = kinds.select(F.col("id").alias("src"), F.col("kind").alias("ka")), kinds.select(F.col("id").alias("dst"), F.col("kind").alias("kb"))
    ends = edges.join(a, "src", "left").join(b, "dst", "left")
    edge = F.concat_ws(" ", "src", "dst", "type")
    owners = nodes.where("kind = 'layer'").select(F.col("id").alias("layer")).distinct()
    files = nodes.where("kind = 'file'")
    found = [
        rule("duplicate node", twice(nodes, "id"), "key"),
        rule("unknown kind", nodes.where(~F.coalesce("kind", F.lit("")).isin("file", "layer")), "id"),
        rule("duplicate edge", twice(edges, "src", "dst", "type"), "key"),
        rule("dangling edge", ends.where("ka is null or kb is null"), edge),
        rule("mixed edge", ends.where("ka <> kb"), edge),
        rule("unknown type", edges.where(~F.coalesce("type", F.lit("")).isin(*EDGE_TYPES)), edge),
        rule("file type", ends.where("ka = 'file' and kb = 'file' and type not in ('import', 'http', 'rpc')"), edge),
        rule("unknown owner", files.join(owners, "layer", "left_anti"), "id"),
    ]
    if inventory is not None:
        found += [
            rule("unsafe path", inventory.where(unsafe(F.col("path"))), "path"),
            rule("duplicate path", twice(inventory, "path"), "key"),
            rule("digest", inventory.where(~F.coalesce("sha256", F.lit("")).rlike(DIGEST)), "path"),
            rule("line count", inventory.where("line_count < 0"), "path"),
            rule("not inventoried", files.join(inventory.select(F.col("path").alias("id")), "id", "left_anti"), "id"),
        ]
    return together(*found)


def folders(nodes: DataFrame) -> DataFrame:
    """Violations of folder nodes(label, parent, depth): no such parent, wrong parent or depth."""
    parent = F.when(F.col("label").contains("/"), F.regexp_replace("label", "/[^/]*$", ""))
    known = nodes.select(F.col("label").alias("parent"))
    return together(
        rule("duplicate folder", twice(nodes, "label"), "key"),
        rule("wrong parent", nodes.where(~F.col("parent").eqNullSafe(parent)), "label"),
        rule("wrong depth", nodes.where(F.col("depth") != F.length("label") - F.length(F.replace("label", F.lit("/"), F.lit("")))), "label"),
        rule("missing parent", nodes.where("parent is not null").join(known, "parent", "left_anti"), "label"),
    )


def symbols(symbols_: DataFrame, sites: DataFrame, inventory: DataFrame) -> DataFrame:
    """Violations of symbols(id, path, start, end), call sites(src, dst, path, line) and inventory(path, line_count)."""
    lines = inventory.select("path", "line_count")
    ids = symbols_.select("id")
    fits = symbols_.join(lines, "path", "left")
    called = sites.join(symbols_.select(F.col("id").alias("src"), F.col("path").alias("home"), "start", "end"), "src", "left")
    site = F.concat_ws(" ", "src", "dst", F.col("line").cast("string"))
    return together(
        rule("duplicate symbol", twice(symbols_, "id"), "key"),
        rule("range", fits.where("line_count is null or start < 1 or end < start or end > line_count"), "id"),
        rule("unknown caller", called.where("home is null"), site),
        rule("site outside caller", called.where("home is not null and (home <> path or line not between start and end)"), site),
        rule("unknown callee", sites.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), site),
    )


def group_specs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Violations of groups(ord, id) and their entries(ord, kind, entry), kind glob or file: ids missing or repeated, both kinds or none, and
    entries that are no path below the root."""
    named = groups.where("coalesce(id, '') <> ''")
    kinds = entries.groupBy("ord").agg(F.count_distinct("kind").alias("kinds"))
    unsafe = (F.coalesce("entry", F.lit("")) == "") | F.col("entry").startswith("/") | F.array_contains(F.split("entry", "/"), "..")
    place = F.col("ord").cast("string")
    return together(
        rule("id missing", groups.where("coalesce(id, '') = ''"), place),
        rule("id repeated", twice(named, "id"), "key"),
        rule("globs or files", groups.join(kinds, "ord", "left").where("coalesce(kinds, 0) <> 1"), place),
        rule("unsafe entry", entries.where(unsafe), F.concat_ws(" ", place, "entry")),
    )


def group_spec(spec: list[dict]) -> list[str]:
    """Problems of a literal group spec: repeated or missing ids, globs and files both or neither, unsafe entries."""
    out, seen = [], set()
    for g in spec:
        if not g.get("id") or g["id"] in seen:
            out.append(f"id {g.get('id')!r}")
        seen.add(g.get("id"))
        if ("globs" in g) == ("files" in g):
            out.append(f"{g.get('id')}: globs or files")
        for entry in [*g.get("globs", []), *g.get("files", [])]:
            if not entry or entry.startswith("/") or ".." in entry.split("/"):
                out.append(f"{g.get('id')}: {entry!r}")
    return out


OPERATIONS = ("LOCATE", "UPSTREAM", "DOWNSTREAM", "PATH", "NOT_SURE", "IMPACT", "CALLERS", "CALLEES", "FLOW", "TRACE")
HIGHLIGHTS = ("relevant", "potential-impact", "changed", "agent-inferred")


def packets(packets_: DataFrame, nodes: DataFrame, edges: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Violations of packets(request_id, operation, status, highlight, seed, selected, edges array<struct<src, dst, type>>, witnesses
    array<array<string>>, alternatives, limitations, truncated, continuation, refs array<struct<path, sha256>>). Packets may lack
    operation, highlight, seed and edges: those of what they lack are not judged."""
    absent = {"operation", "highlight", "seed", "edges"} - set(packets_.columns)
    fill = {c: F.lit(None).cast("string") for c in absent - {"edges"}}
    if "edges" in absent:
        fill["edges"] = F.array().cast("array<struct<src:string,dst:string,type:string>>")
    packets_ = packets_.withColumns(fill) if fill else packets_
    hop = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    picked = packets_.select("request_id", F.explode("selected").alias("id"))
    chains = packets_.select("request_id", F.explode("witnesses").alias("chain"))
    hops = chains.select("request_id", F.explode(hop("chain")).alias("h")).select("request_id", "h.src", "h.dst")
    shown = packets_.select("request_id", "selected", F.explode("edges").alias("e")).select("request_id", "selected", "e.src", "e.dst", "e.type")
    moving = edges.where(~F.col("type").isin("realtime"))
    none = packets_.where(F.col("status").isin("needs-choice", "no-match", "stale"))
    id_, link = F.col("request_id"), F.concat_ws(" ", "request_id", "src", "dst")
    impact = packets_.where("highlight = 'potential-impact'")
    backed = F.transform(F.filter("witnesses", lambda w: (F.size(w) > 1) & (F.element_at(w, -1) == F.col("seed"))), lambda w: F.element_at(w, 1))
    bare = F.size(F.array_except(F.array_except("selected", F.array("seed")), backed)) > 0
    found = [
        rule("request id", packets_.where("coalesce(request_id, '') = '' or length(request_id) > 512"), id_),
        rule("unknown status", packets_.where(~F.coalesce("status", F.lit("")).isin(*STATUSES)), id_),
        rule("unknown operation", packets_.where(~F.coalesce("operation", F.lit("")).isin(*OPERATIONS) & F.lit("operation" not in absent)), id_),
        rule("unknown highlight", packets_.where(~F.coalesce("highlight", F.lit("")).isin(*HIGHLIGHTS) & F.lit("highlight" not in absent)), id_),
        rule("selected twice", packets_.where(F.size("selected") != F.size(F.array_distinct("selected"))), id_),
        rule("unknown node", picked.join(nodes.select("id").distinct(), "id", "left_anti"), F.concat_ws(" ", "request_id", "id")),
        rule("edge shown twice", packets_.where(F.size("edges") != F.size(F.array_distinct("edges"))), id_),
        rule("edge not observed", shown.join(moving.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti"), link),
        rule("edge outside the selection", shown.where(~F.array_contains("selected", F.col("src")) | ~F.array_contains("selected", F.col("dst"))), link),
        rule("empty witness", chains.where("size(chain) = 0"), id_),
        rule("witness meets a node twice", chains.where(F.size("chain") != F.size(F.array_distinct("chain"))), id_),
        rule("hop is no edge", hops.join(moving.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), link),
        rule("alternative twice", packets_.where(F.size("alternatives") != F.size(F.array_distinct("alternatives"))), id_),
        rule("matched without nodes", packets_.where("status = 'matched' and size(selected) = 0"), id_),
        rule("nodes where none may be", none.where("size(selected) > 0 or size(edges) > 0 or size(witnesses) > 0"), id_),
        rule("path where there is none", packets_.where("status = 'no-path' and (operation not in ('PATH', 'FLOW') or size(edges) > 0 or size(witnesses) > 0)"), id_),
        rule("impact of no dependents", impact.where("status <> 'matched' or operation not in ('IMPACT', 'DOWNSTREAM')"), id_),
        rule("impact without its seed", impact.where(~F.coalesce(F.array_contains("selected", F.col("seed")), F.lit(False))), id_),
        rule("impact without a consumer", impact.where("size(selected) < 2"), id_),
        rule("impact without a witness", impact.where(bare), id_),
        rule("unsupported without reason", packets_.where("status = 'unsupported' and size(limitations) = 0"), id_),
        rule("too many", packets_.where((F.size("selected") > CAPS["nodes"]) | (F.size("edges") > CAPS["edges"]) | (F.size("witnesses") > CAPS["witnesses"]) | (F.size("alternatives") > CAPS["alternatives"]) | (F.size("limitations") > 100)), id_),
        rule("long limitation", packets_.where(F.exists("limitations", lambda x: F.length(x) > 2048)), id_),
        rule("truncated without continuation", packets_.where("truncated <> (continuation is not null)"), id_),
    ]
    if inventory is not None:
        refs = packets_.select("request_id", F.explode("refs").alias("r")).select("request_id", "r.path", "r.sha256")
        found.append(rule("reference not inventoried", refs.join(inventory.select("path", "sha256"), ["path", "sha256"], "left_anti"), F.concat_ws(" ", "request_id", "path")))
    return together(*found)


def tours(steps: DataFrame, links: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of steps(tour, step, path, start, end) and links(tour, src, dst, type) against files(path, lines) and edges."""
    told = steps.join(files.select("path", "lines"), "path", "left")
    where = F.concat_ws(" ", "tour", F.col("step").cast("string"), "path")
    involved = steps.select("tour", F.col("path").alias("p")).distinct()
    away = links.join(involved, (links["tour"] == involved["tour"]) & (links["src"] == F.col("p")), "left_anti").unionByName(links.join(involved, (links["tour"] == involved["tour"]) & (links["dst"] == F.col("p")), "left_anti")).distinct()
    link = F.concat_ws(" ", "tour", "src", "dst")
    return together(
        rule("unmapped source", told.where("lines is null"), where),
        rule("line bounds", told.where("lines is not null and (start < 1 or end < start or end > lines)"), where),
        rule("more than fifty lines", told.where("end - start > 49"), where),
        rule("link outside the tour", away, link),
        rule("import link not observed", links.where("type = 'import'").join(edges.where("type = 'import'").select("src", "dst").distinct(), ["src", "dst"], "left_anti"), link),
    )


def provenance(findings: DataFrame, counts: DataFrame, extracted: DataFrame, unscanned: DataFrame, files: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Violations of findings(category, path, target), their counts(category, n) and the partition of files(path) into extracted and
    unscanned ones."""
    again = findings.groupBy("category").agg(F.count("*").alias("found"))
    every = extracted.select("path").unionByName(unscanned.select("path"))
    return together(
        rule("unknown category", findings.where(~F.col("category").isin(*categories)).select("category").distinct(), "category"),
        rule("empty field", findings.where("coalesce(path, '') = '' or coalesce(target, '') = ''"), F.concat_ws(" ", "category", "path")),
        rule("count", counts.join(again, "category", "full_outer").where("coalesce(n, 0) <> coalesce(found, 0)"), "category"),
        rule("scanned and not", extracted.select("path").intersect(unscanned.select("path")), "path"),
        rule("neither scanned nor not", files.select("path").exceptAll(every.distinct()), "path"),
        rule("no source file", every.distinct().join(files, "path", "left_anti"), "path"),
    )


def feedback(records: DataFrame, nodes: DataFrame, map_digest: str, scorer_digest: str) -> DataFrame:
    """records(id, map_sha, scorer_sha, target, ...) with ``reason``: why a record may not be used against this map, or null."""
    known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct()
    told = records.join(known, "target", "left")
    reason = F.when(F.col("map_sha") != map_digest, "other map").when(F.col("scorer_sha") != scorer_digest, "other scorer").when(F.col("target").isNotNull() & F.col("known").isNull(), "unknown target")
    return told.withColumn("reason", reason).drop("known")


def explanations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Violations of citations(explanation_id, statement, inferred, evidence_id): neither cited nor said to be inferred, or unknown evidence."""
    return together(
        rule("neither cited nor inferred", citations.where("evidence_id is null and not coalesce(inferred, false)"), F.concat_ws(" ", "explanation_id", "statement")),
        rule("unknown evidence", citations.where("evidence_id is not null").join(evidence.select("evidence_id"), "evidence_id", "left_anti"), F.concat_ws(" ", "explanation_id", "evidence_id")),
    )


def same_rows(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows that two builds do not share, but for ignored columns: a rebuild must give none."""
    keep = [c for c in a.columns if c not in ignored]
    x, y = a.select(*keep), b.select(*keep)
    text = F.to_json(F.struct(*keep))
    return together(rule("only before", x.exceptAll(y), text), rule("only after", y.exceptAll(x), text))


def scores(heads: DataFrame) -> DataFrame:
    """Violations of heads(qid, rank, score, p): probabilities that do not sum to one, ranks out of order."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy("rank")
    return together(
        rule("sum", heads.groupBy("qid").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-6"), "qid"),
        rule("order", heads.withColumn("before", F.lag("score").over(order)).where("score > before"), "qid"),
        rule("range", heads.where("p < 0 or p > 1"), "qid"),
    )


def alias_problem(alias, node):
    """Why an alias may not be stored, or null."""
    blank = F.trim(F.coalesce(alias, F.lit(""))) == ""
    return F.when(blank, "blank").when(alias.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control character").when(F.length(alias) > 160, "too long").when(alias != F.trim(alias), "outer space").when(F.coalesce(node, F.lit("")) == "", "no target").when(F.length(node) > 1024, "no target")
