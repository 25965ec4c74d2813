"""Queries of integrity: whole tables into which faults are planted, and the rules that must find each and nothing else."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.operators import assign, graph, quantiles, validate
from archlens.plans.base import query
from archlens.plans.graphs import BACKWARD, SEEDS, starts, walk_sql
from archlens.plans.library import CATEGORIES, FINDINGS, findings
from archlens.sources.tables import call_sites, code_files, code_symbols, file_graph, path_edges, seeds, table

# A snapshot with faults, by number of a file.
NODES = """nodes as (select path as id, 'file' as kind, case when fid % 97 = 5 then 'nowhere' else top end as layer from code_files union all select path, 'file', top from code_files where fid % 89 = 3
    union all select top, case when top = 'brand7' then 'room' else 'layer' end, top from (select distinct top from code_files))"""
EDGES = """edges as (select src, dst, type from path_edges where type <> 'realtime' union all select path, path || 'x', 'import' from code_files where fid % 61 = 4 union all select path, top, 'import' from code_files where fid % 67 = 8
    union all select path, path, 'magic' from code_files where fid % 71 = 9 union all select src, dst, type from path_edges join code_files on src = path where fid % 73 = 1 and type = 'rpc')"""
INVENTORY = "inventory as (select case when fid % 53 = 2 then '../' || path else path end as path, case when fid % 59 = 6 then left(sha256(path), 40) else sha256(path) end as sha256, case when fid % 47 = 3 then -1 else lines end as line_count from code_files where fid % 83 <> 7)"


def nodes(spark, sf_dir):
    files = code_files(spark, sf_dir)
    own = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.when(F.col("fid") % 97 == 5, "nowhere").otherwise(F.col("top")).alias("layer"))
    again = files.where("fid % 89 = 3").select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.col("top").alias("layer"))
    tops = files.select("top").distinct().select(F.col("top").alias("id"), F.when(F.col("top") == "brand7", "room").otherwise("layer").alias("kind"), F.col("top").alias("layer"))
    return own.unionByName(again).unionByName(tops)


def edges(spark, sf_dir):
    files, plain = code_files(spark, sf_dir), path_edges(spark, sf_dir).where("type <> 'realtime'").select("src", "dst", "type")
    made = lambda where, dst, type_: files.where(where).select(F.col("path").alias("src"), dst.alias("dst"), F.lit(type_).alias("type"))
    again = plain.where("type = 'rpc'").join(files.where("fid % 73 = 1").select(F.col("path").alias("src")), "src").select("src", "dst", "type")
    return plain.unionByName(made("fid % 61 = 4", F.concat("path", F.lit("x")), "import")).unionByName(made("fid % 67 = 8", F.col("top"), "import")).unionByName(made("fid % 71 = 9", F.col("path"), "magic")).unionByName(again)


def inventory(spark, sf_dir):
    digest = F.sha2("path", 256)
    return code_files(spark, sf_dir).where("fid % 83 <> 7").select(F.when(F.col("fid") % 53 == 2, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("fid") % 59 == 6, F.substring(digest, 1, 40)).otherwise(digest).alias("sha256"), F.when(F.col("fid") % 47 == 3, -1).otherwise(F.col("lines")).alias("line_count"))


@query(
    "violations_snapshot",
    f"""with {NODES}, {EDGES}, {INVENTORY}, k as (select distinct id, kind from nodes), e as (select e.*, a.kind as ka, b.kind as kb from edges e left join k a on e.src = a.id left join k b on e.dst = b.id)
    select 'duplicate node' as rule, id as what from nodes group by id having count(*) > 1 union all select 'unknown kind', id from nodes where kind not in ('file', 'layer')
    union all select 'duplicate edge', src || ' ' || dst || ' ' || type from edges group by src, dst, type having count(*) > 1
    union all select 'dangling edge', src || ' ' || dst || ' ' || type from e where ka is null or kb is null union all select 'mixed edge', src || ' ' || dst || ' ' || type from e where ka <> kb
    union all select 'unknown type', src || ' ' || dst || ' ' || type from edges where type = 'magic' union all select 'file type', src || ' ' || dst || ' ' || type from e where ka = 'file' and kb = 'file' and type not in ('import', 'http', 'rpc')
    union all select 'unknown owner', id from nodes where kind = 'file' and layer not in (select id from nodes where kind = 'layer')
    union all select 'unsafe path', path from inventory where starts_with(path, '../') union all select 'digest', path from inventory where length(sha256) <> 64 union all select 'line count', path from inventory where line_count < 0
    union all select 'not inventoried', id from nodes where kind = 'file' and id not in (select path from inventory)""",
    ("code_files", "path_edges"),
)
def violations_snapshot(spark, sf_dir):
    """Nodes, edges and inventory of a snapshot against thirteen rules."""
    return validate.snapshot(nodes(spark, sf_dir), edges(spark, sf_dir), inventory(spark, sf_dir))


SITES = "sites as (select case when position % 997 = 3 then src || '?' else src end as src, case when position % 991 = 4 then dst || '?' else dst end as dst, path, line from call_sites where dst is not null)"
CATALOGUE = "symbols as (select id, path, case when sid % 43 = 2 then 0 else 1 end as start, case when sid % 41 = 5 then lines + 9 else lines end as stop from code_symbols)"


@query(
    "violations_symbols",
    f"""with {SITES}, {CATALOGUE}, inv as (select path, lines from code_files where fid % 83 <> 7)
    select 'range' as rule, id as what from symbols left join inv using (path) where lines is null or start < 1 or stop < start or stop > lines
    union all select 'unknown caller', concat_ws(' ', src, s.dst, cast(line as varchar)) from sites s where src not in (select id from symbols)
    union all select 'site outside caller', concat_ws(' ', src, s.dst, cast(line as varchar)) from sites s join symbols y on s.src = y.id where y.path <> s.path or line not between start and stop
    union all select 'unknown callee', concat_ws(' ', src, s.dst, cast(line as varchar)) from sites s where dst not in (select id from symbols)""",
    ("code_files", "code_symbols", "call_sites"),
)
def violations_symbols(spark, sf_dir):
    """Definitions and call sites: ranges inside the source, sites inside their caller, both ends known."""
    symbols = code_symbols(spark, sf_dir).select("id", "path", F.when(F.col("sid") % 43 == 2, 0).otherwise(1).alias("start"), (F.col("lines") + F.when(F.col("sid") % 41 == 5, 9).otherwise(0)).alias("end"))
    broken = lambda c, n, r: F.when(F.col("position") % n == r, F.concat(c, F.lit("?"))).otherwise(F.col(c)).alias(c)
    sites = call_sites(spark, sf_dir).where("dst is not null").select(broken("src", 997, 3), broken("dst", 991, 4), "path", "line")
    known = code_files(spark, sf_dir).where("fid % 83 <> 7").select("path", F.col("lines").alias("line_count"))
    return validate.symbols(symbols, sites, known)


@query(
    "violations_folders",
    """with every as (select distinct unnest([top, folder]) as label from code_files), f as (select label, case when label like '%/promo' then 'brand1' when contains(label, '/') then split_part(label, '/', 1) end as parent,
      len(string_split(label, '/')) - case when label like '%/small' then 2 else 1 end as depth from every where label <> 'brand9' union all select 'brand2', null, 0)
    select 'duplicate folder' as rule, label as what from f group by label having count(*) > 1 union all select 'wrong parent', label from f where parent is distinct from case when contains(label, '/') then split_part(label, '/', 1) end
    union all select 'wrong depth', label from f where depth <> len(string_split(label, '/')) - 1 union all select 'missing parent', label from f where parent is not null and parent not in (select label from f)""",
    ("code_files",),
)
def violations_folders(spark, sf_dir):
    """A folder catalogue with a parent missing, wrong parents and depths, and a folder twice."""
    every = assign.folders(code_files(spark, sf_dir)).where("label <> 'brand9'")
    made = every.withColumn("parent", F.when(F.col("label").endswith("/promo"), "brand1").otherwise(F.col("parent"))).withColumn("depth", F.col("depth") - F.col("label").endswith("/small").cast("int"))
    return validate.folders(made.unionByName(spark.createDataFrame([("brand2", None, 0)], made.schema)))


#: Packets of what depends on each question's file, the first 150 rows; each number of a question has a fault of its own.
PACKETS = walk_sql(
    SEEDS,
    BACKWARD,
    """, r as (select qid, id, depth, list_reverse(chain) as w, row_number() over (partition by qid order by depth, chain) as n from best where depth > 0),
    p as (select s.qid, s.path as seed, coalesce(list(r.id order by n) filter (n <= 150), []) as ids, coalesce(list(w order by n) filter (n <= 150), []) as ws, count(r.id) > 150 as cut from seeds s left join r on s.qid = r.qid group by 1, 2)""",
)
FAULTS = (
    ("unknown status", 1), ("unknown operation", 2), ("selected twice", 3), ("unknown node", 4), ("matched without nodes", 5), ("nodes where none may be", 6), ("path where there is none", 7), ("unsupported without reason", 8),
    ("truncated without continuation", 9), ("too many", 10), ("long limitation", 11), ("unknown highlight", 12), ("alternative twice", 13), ("empty witness", 14),
)


@query(
    "violations_packets",
    PACKETS
    + """ select rule, n_rows from (
      select 'unknown status' as rule, count(*) as n_rows from p where qid = 1 union all select 'unknown operation', count(*) from p where qid = 2 union all select 'selected twice', count(*) from p where qid = 3 union all select 'unknown node', count(*) from p where qid = 4
      union all select 'matched without nodes', count(*) from p where qid = 5 union all select 'nodes where none may be', count(*) from p where qid = 6 union all select 'path where there is none', count(*) from p where qid = 7 union all select 'unsupported without reason', count(*) from p where qid = 8
      union all select 'truncated without continuation', count(*) from p where qid = 9 union all select 'too many', count(*) from p where qid = 10 union all select 'long limitation', count(*) from p where qid = 11 union all select 'unknown highlight', count(*) from p where qid = 12
      union all select 'alternative twice', count(*) from p where qid = 13 union all select 'empty witness', count(*) from p where qid = 14
      union all select 'hop is no edge', count(*) from p where qid = 15 and len(ws) > 0 union all select 'witness meets a node twice', count(*) from p where qid = 15 and len(ws) > 0 union all select 'impact without a witness', count(*) from p where qid = 16 and len(ws) > 0) where n_rows > 0""",
    ("seeds", "path_edges"),
    recursive=True,
)
def violations_packets(spark, sf_dir):
    """Packets with one fault each against all rules for packets: how often each rule is broken."""
    packs = graph.cut(faulty_packets(spark, sf_dir))
    files = code_files(spark, sf_dir).select(F.col("path").alias("id"))
    return validate.packets(packs, files, path_edges(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n_rows"))


def packets(spark, sf_dir):
    """A packet for each question: what depends on its file, whole chains, and where to go on."""
    rows = graph.first_reached(starts(spark, sf_dir), most=150, **file_graph(spark, sf_dir, reverse=True))
    told = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "id", F.reverse("chain").alias("w")))).alias("l"), F.max("total").alias("total"))
    of = lambda c: F.coalesce(F.transform("l", lambda x: x[c]), F.array().cast("array<string>" if c == "id" else "array<array<string>>"))
    base = seeds(spark, sf_dir).join(told, "qid", "left")
    more = F.coalesce(F.col("total"), F.lit(0)) > 150
    none = F.array().cast("array<string>")
    return base.select(
        F.concat(F.lit("r"), F.col("qid").cast("string")).alias("request_id"), F.lit("DOWNSTREAM").alias("operation"), F.lit("matched").alias("status"), F.when(F.size(of("id")) > 0, "potential-impact").otherwise("relevant").alias("highlight"), F.col("path").alias("seed"),
        F.concat(F.array("path"), of("id")).alias("selected"), F.array().cast("array<struct<src:string,dst:string,type:string>>").alias("edges"), of("w").alias("witnesses"), none.alias("alternatives"), F.array(F.lit("Static links only.")).alias("limitations"),
        more.alias("truncated"), F.when(more, "offset:150").alias("continuation"), "qid",
    )


def faulty_packets(spark, sf_dir):
    rows = packets(spark, sf_dir)
    at = lambda *n: F.col("qid").isin(*n)
    c, none = F.col, F.array().cast("array<string>")
    plain = at(5, 6, 7, 8, 14)
    chains = F.array().cast("array<array<string>>")
    rows = rows.withColumn("highlight", F.when(plain | at(1, 3, 4, 10), "relevant").when(at(12), "loud").otherwise(c("highlight")))
    rows = rows.withColumn("operation", F.when(at(2), "GUESS").when(at(12), "LOCATE").otherwise(c("operation"))).withColumn("highlight", F.when(at(2), "relevant").otherwise(c("highlight")))
    rows = rows.withColumn("status", F.when(at(1), "perhaps").when(at(6), "no-match").when(at(7), "no-path").when(at(8), "unsupported").otherwise(c("status")))
    rows = rows.withColumn("selected", F.when(at(3), F.concat(F.array("seed"), F.array("seed"))).when(at(4), F.array(c("seed"), F.lit("nowhere.py"))).when(at(5), none).when(at(6, 7, 8), F.array("seed")).when(at(10), F.array("seed")).when(at(14), F.array("seed")).otherwise(c("selected")))
    shifted = F.transform("witnesses", lambda w, i: F.when(i == 0, F.concat(F.array(F.element_at(w, 1)), F.array(F.lit("between.py")), F.slice(w, 2, F.size(w)))).otherwise(w))
    rows = rows.withColumn("witnesses", F.when(plain & ~at(14), chains).when(at(1, 3, 4, 10), chains).when(at(14), F.array(none)).when(at(15), F.when(F.size("witnesses") > 0, F.array(F.array(F.element_at(F.element_at("witnesses", 1), 1), c("seed"), F.element_at(F.element_at("witnesses", 1), 1)))).otherwise(c("witnesses"))).when(at(16), F.slice("witnesses", 2, 999)).otherwise(c("witnesses")))
    rows = rows.withColumn("highlight", F.when(at(15), "relevant").otherwise(c("highlight")))
    many = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    rows = rows.withColumn("alternatives", F.when(at(10), many).when(at(13), F.array(F.lit("a"), F.lit("a"))).otherwise(c("alternatives")))
    rows = rows.withColumn("limitations", F.when(at(8), none).when(at(11), F.array(F.lit("x" * 2049))).otherwise(c("limitations")))
    return rows.withColumn("truncated", F.when(at(9), ~c("truncated")).otherwise(c("truncated"))).drop("qid")


STEPS = "steps as (select 'tour ' || top as tour, fid as step, path, 1 as start, case when fid % 31 = 2 then lines + 1 when fid % 29 = 3 then 60 else least(lines, 50) end as stop from code_files where fid % 37 <> 1 union all select 'lost', 1, 'nowhere.py', 1, 2)"
LINKS = "links as (select 'tour ' || src_top as tour, src, dst, type from path_edges where src_top = dst_top and type in ('import', 'http') union all select 'tour ' || a.top, a.path, b.path, 'import' from code_files a join code_files b on b.fid = a.fid + 25 and a.top = b.top where a.fid % 7 = 0)"


@query(
    "violations_tours",
    f"""with {STEPS}, {LINKS}, t as (select s.*, lines from steps s left join code_files f using (path))
    select 'unmapped source' as rule, concat_ws(' ', tour, cast(step as varchar), path) as what from t where lines is null union all select 'line bounds', concat_ws(' ', tour, cast(step as varchar), path) from t where stop > lines or stop < start
    union all select 'more than fifty lines', concat_ws(' ', tour, cast(step as varchar), path) from t where stop - start > 49
    union all select distinct 'link outside the tour', concat_ws(' ', l.tour, src, dst) from links l where not exists (select 1 from steps s where s.tour = l.tour and s.path = src) or not exists (select 1 from steps s where s.tour = l.tour and s.path = dst)
    union all select 'import link not observed', concat_ws(' ', tour, src, dst) from links l where type = 'import' and not exists (select 1 from path_edges e where e.src = l.src and e.dst = l.dst and e.type = 'import')""",
    ("code_files", "path_edges"),
)
def violations_tours(spark, sf_dir):
    """Tours whose citations leave their source, whose links leave the tour, or name an import that is not there."""
    files, edges_ = code_files(spark, sf_dir), path_edges(spark, sf_dir)
    stop = F.when(F.col("fid") % 31 == 2, F.col("lines") + 1).when(F.col("fid") % 29 == 3, 60).otherwise(F.least("lines", F.lit(50)))
    steps = files.where("fid % 37 <> 1").select(F.concat(F.lit("tour "), "top").alias("tour"), F.col("fid").alias("step"), "path", F.lit(1).alias("start"), stop.alias("end"))
    steps = steps.unionByName(spark.createDataFrame([("lost", 1, "nowhere.py", 1, 2)], "tour string, step long, path string, start int, end int"))
    links = edges_.where("src_top = dst_top and type in ('import', 'http')").select(F.concat(F.lit("tour "), "src_top").alias("tour"), "src", "dst", "type")
    a, b = files.where("fid % 7 = 0").select("top", (F.col("fid") + 25).alias("fid"), F.col("path").alias("src")), files.select("top", "fid", F.col("path").alias("dst"))
    links = links.unionByName(a.join(b, ["top", "fid"]).select(F.concat(F.lit("tour "), "top").alias("tour"), "src", "dst", F.lit("import").alias("type")))
    return validate.tours(steps, links, files, edges_)


@query("violations_explanations", "with c as (select doc_id, doc_id % 5 = 0 as inferred, case when doc_id % 3 > 0 then case when doc_id % 11 = 0 then -1 - doc_id else doc_id end end as evidence from documents) select 'neither cited nor inferred' as rule, doc_id || ' 1' as what from c where evidence is null and not inferred union all select 'unknown evidence', doc_id || ' ' || evidence from c where evidence < 0")
def violations_explanations(spark, sf_dir):
    """Statements that are neither cited nor said to be inferred, and citations of what is not there."""
    docs, d = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    made = docs.select(d.cast("string").alias("explanation_id"), F.lit("1").alias("statement"), (d % 5 == 0).alias("inferred"), F.when(d % 3 > 0, F.when(d % 11 == 0, -1 - d).otherwise(d)).cast("string").alias("evidence_id"))
    return validate.explanations(made, docs.select(d.cast("string").alias("evidence_id")))


@query(
    "violations_provenance",
    f"with {FINDINGS}, told as (select category, count(*) + case when category = 'resolved_source' then 1 else 0 end as n from findings group by 1), ex as (select path from code_files where fid % 5 <> 0 union all select 'ghost.py'), un as (select path from code_files where fid % 5 = 0 and fid % 45 <> 0 union all select path from code_files where fid % 101 = 1)"
    " select 'count' as rule, 'resolved_source' as what from told where category = 'resolved_source' union all select 'scanned and not', path from (select path from ex intersect select path from un) union all select 'neither scanned nor not', path from code_files where path not in (select path from ex) and path not in (select path from un) union all select 'no source file', 'ghost.py'",
    ("code_files", "path_edges"),
)
def violations_provenance(spark, sf_dir):
    """Findings with a wrong count, files that are scanned and not scanned, neither, or unknown."""
    rows, files = findings(spark, sf_dir), code_files(spark, sf_dir)
    counts = rows.groupBy("category").agg((F.count("*") + F.max((F.col("category") == CATEGORIES[0]).cast("int"))).alias("n"))
    extracted = files.where("fid % 5 <> 0").select("path").unionByName(spark.createDataFrame([("ghost.py",)], "path string"))
    unscanned = files.where("fid % 5 = 0 and fid % 45 <> 0").select("path").unionByName(files.where("fid % 101 = 1").select("path"))
    return validate.provenance(rows, counts, extracted, unscanned, files.select("path"), CATEGORIES)


@query("feedback_eligibility", "select doc_id as id, case when doc_id % 7 = 0 then 'other map' when doc_id % 5 = 0 then 'other scorer' when doc_id % 3 = 0 then 'unknown target' end as reason from labels")
def feedback_eligibility(spark, sf_dir):
    """Why a labelled question may not be used against this map."""
    d = F.col("doc_id")
    records = table(spark, sf_dir, "labels").select(d.alias("id"), F.when(d % 7 == 0, "m0").otherwise("m1").alias("map_sha"), F.when(d % 5 == 0, "s0").otherwise("s1").alias("scorer_sha"), F.when(d % 3 == 0, F.concat(F.lit("gone"), d.cast("string"))).otherwise(F.concat(F.lit("d"), d.cast("string"))).alias("target"))
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), d.cast("string")).alias("id"))
    return validate.feedback(records, known, "m1", "s1").select("id", "reason")


@query("certain_reconstruction", "with inferred as (select src, path, line from call_sites where confidence in ('instance-local', 'typed', 'through-decorator')), told as (select src, path, line from call_sites where confidence in ('instance-local', 'typed', 'through-decorator') and position % 401 <> 7) select 'only before' as rule, count(*) as n from (select * from inferred except all select * from told) having count(*) > 0", ("call_sites",))
def certain_reconstruction(spark, sf_dir):
    """Additions of the certain view against inferred call sites, with multiplicity: some are missing."""
    rows = call_sites(spark, sf_dir).where("confidence in ('instance-local', 'typed', 'through-decorator')")
    return validate.same_rows(rows.select("src", "path", "line"), rows.where("position % 401 <> 7").select("src", "path", "line")).groupBy("rule").agg(F.count("*").alias("n"))


@query("map_completeness", "select what, n > 0 as ok from (select 'groups' as what, (select count(distinct top) from code_files) as n union all select 'files', (select count(*) from code_files) union all select 'file edges', (select count(*) from path_edges) union all select 'groups with files', (select count(*) from (select top from code_files group by top having count(*) > 0)) union all select 'tours', 0)", ("code_files", "path_edges"))
def map_completeness(spark, sf_dir):
    """Which parts of a map there are."""
    files = code_files(spark, sf_dir)
    parts = {"groups": files.select("top").distinct(), "files": files, "file edges": path_edges(spark, sf_dir), "groups with files": files.groupBy("top").count(), "tours": files.where("false")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("what"), (F.count("*") > 0).alias("ok"))
        out = row if out is None else out.union(row)
    return out


@query("release_evidence", "select event_type, n >= 30 as enough, p95 < 40 as fast, n from (select event_type, count(*) as n, quantile_disc(value, 0.95) as p95 from events where value is not null group by 1)")
def release_evidence(spark, sf_dir):
    """Whether there are enough measurements of each kind and the slow ones are fast enough."""
    rows = quantiles.exact_quantiles(table(spark, sf_dir, "events"), "event_type", "value", (0.95,))
    return rows.select("event_type", (F.col("n") >= 30).alias("enough"), (F.col("value") < 40).alias("fast"), "n")


@query("stored_summary", "with now as (select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1), stored as (select lang, n, chars + case when lang = (select min(lang) from now) then 1 else 0 end as chars from now) select case when s.lang is null then 'only before' else 'only after' end as rule, 1 as n from now n full join stored s on n.lang = s.lang and n.n = s.n and n.chars = s.chars where s.lang is null or n.lang is null")
def stored_summary(spark, sf_dir):
    """A summary that is computed again against the one that was stored: one language differs."""
    now = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    first = now.agg(F.min("lang").alias("first"))
    stored = now.crossJoin(F.broadcast(first)).select("lang", "n", (F.col("chars") + (F.col("lang") == F.col("first")).cast("int")).alias("chars"))
    return validate.same_rows(now, stored).select("rule", F.lit(1).alias("n"))
