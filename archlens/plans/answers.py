"""Queries of the answer plane: ranking of files and groups, decisions, the flagship and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, qlog, ranking
from archlens.plans.base import query
from archlens.plans.graphs import BACKWARD, FORWARD, SEEDS, starts, walk_sql
from archlens.plans.text import NORMAL
from archlens.sources.tables import code_files, file_graph, seeds

ASKED = "asked as (select qid, 'What depends on ' || path || '?' as question from seeds)"


@query(
    "q_dependents",
    walk_sql(f"select qid, f.path as id from (select qid, regexp_extract({NORMAL.format('question')}, '^(what|which|who)\\s+(\\w+\\s+)?(depends? on|uses?|imports?)\\s+(.+)$', 4) as target from (select qid, 'What depends on ' || path || '?' as question from seeds)) join code_files f on lower(f.path) = target", BACKWARD, "select qid, 'DOWNSTREAM' as op, chain[1] as target, id, depth, array_to_string(list_reverse(chain), '>') as witness from best where depth > 0"),
    ("seeds", "path_edges"),
    recursive=True,
)
def q_dependents(spark, sf_dir):
    """A batch of questions end to end: parse, bind the exact path, search backwards, one row for each consumer with its witness."""
    asked = seeds(spark, sf_dir).select("qid", F.concat(F.lit("What depends on "), "path", F.lit("?")).alias("question"))
    parsed = asked.select("qid", T.intent(T.normalize_question(F.col("question"))).alias("i")).where("i.op = 'DOWNSTREAM'").select("qid", "i.op", "i.target")
    files = code_files(spark, sf_dir).select("path", F.lower("path").alias("target"))
    bound = parsed.join(files, "target").select("qid", "op", F.col("path").alias("id"))
    found = graph.search(bound.select("qid", "id"), **file_graph(spark, sf_dir, reverse=True))
    return found.where("depth > 0").select("qid", F.lit("DOWNSTREAM").alias("op"), F.element_at("chain", 1).alias("target"), "id", "depth", F.array_join(F.reverse("chain"), ">").alias("witness"))


#: Rows that tie at the top are told apart by number: short names that many files begin with.
HEAD_SQL = """with s as (select qid, f.path as id, 30.0 - levenshtein(f.folder, split_part(s.path, '/', 1) || '/' || split_part(s.path, '/', 2)) as score, f.fid as idx from seeds s join code_files f on f.top = split_part(s.path, '/', 1)),
  h as (select *, row_number() over w as rank, score - coalesce(lead(score) over w, 0) as margin, exp((score - max(score) over (partition by qid)) / 1.5) as e from s window w as (partition by qid order by score desc, idx))"""


def scores(spark, sf_dir):
    """(qid, idx, id, score): the files of each question's group by how near their folder is to its own."""
    own = seeds(spark, sf_dir).select("qid", F.substring_index("path", "/", 1).alias("top"), F.substring_index("path", "/", 2).alias("home"))
    files = code_files(spark, sf_dir).select("top", "folder", F.col("path").alias("id"), F.col("fid").alias("idx"))
    return files.join(F.broadcast(own), "top").select("qid", "idx", "id", (30.0 - F.levenshtein("folder", "home")).alias("score"))


@query("softmax_head", HEAD_SQL + " select qid, rank, id, round(e / sum(e) over (partition by qid), 6) as p, cast(margin as double) as margin from h qualify rank <= 3", ("code_files", "seeds"))
def softmax_head(spark, sf_dir):
    """The three best of each question with probability and margin; equal scores in order of their number."""
    rows = ranking.head(scores(spark, sf_dir))
    return rows.where("rank <= 3").select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("p", 6).alias("p"), F.col("margin").cast("double").alias("margin"))


@query("tied_best", HEAD_SQL + " select qid, id, cast(score as double) as score from (select *, rank() over (partition by qid order by score desc) as place from h) where place = 1 or rank <= 3", ("code_files", "seeds"))
def tied_best(spark, sf_dir):
    """All that share the best score, filled up to three."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"))
    rows = scores(spark, sf_dir).withColumn("place", F.rank().over(best)).withColumn("n", F.row_number().over(best.orderBy(F.desc("score"), "idx")))
    return rows.where("place = 1 or n <= 3").select("qid", "id", F.col("score").cast("double").alias("score"))


ALIASES = [("The Hub", "brand11"), ("the hub ", "brand12"), ("core", "brand22"), ("economy", "brand33"), ("  Core", "brand22")]
ALIAS_SQL = "aliases(alias, node) as (values " + ", ".join(f"('{a}', '{n}')" for a, n in ALIASES) + ")"


@query("alias_overlay", f"with {ALIAS_SQL} select lower(trim(regexp_replace(alias, '\\s+', ' ', 'g'))) as alias, count(distinct node) as targets, min(node) as node, count(distinct node) > 1 as conflict, bool_and(node not in (select top from code_files)) as orphan from aliases group by 1", ("code_files",))
def alias_overlay(spark, sf_dir):
    """Aliases by normalised text, with conflicts and orphans marked."""
    rows = spark.createDataFrame(ALIASES, "alias string, node string").withColumn("alias", F.lower(F.trim(F.regexp_replace("alias", r"\s+", " "))))
    known = code_files(spark, sf_dir).select(F.col("top").alias("node"), F.lit(True).alias("known")).distinct()
    out = rows.join(known, "node", "left").groupBy("alias").agg(F.count_distinct("node").alias("targets"), F.min("node").alias("node"), F.bool_and(F.col("known").isNull()).alias("orphan"))
    return out.withColumn("conflict", F.col("targets") > 1)


_merged = "select initcap_ || '  ' || w2 as alias, top as node, 0 as ord from w where fid % 2 = 0 union all select ' ' || upper(w1) || ' ' || w2 || ' ', top, 1 from w where fid % 3 = 0"


@query(
    "alias_merge",
    f"""with w as (select fid, top, split_part(stem, '_', 1) as w1, upper(left(stem, 1)) || substr(split_part(stem, '_', 1), 2) as initcap_, split_part(stem, '_', 2) as w2 from code_files), m as ({_merged})
    select lower(trim(regexp_replace(alias, '\\s+', ' ', 'g'))) as alias, node, min(ord) as store from m group by 1, 2""",
    ("code_files",),
)
def alias_merge(spark, sf_dir):
    """Two stores of aliases put together: each normalised alias of a node once, from the store that comes first."""
    files = code_files(spark, sf_dir).select("fid", "top", F.split("stem", "_").alias("w"))
    own = files.where("fid % 2 = 0").select(F.concat(F.initcap(F.get("w", F.lit(0))), F.lit("  "), F.get("w", F.lit(1))).alias("alias"), F.col("top").alias("node"))
    other = files.where("fid % 3 = 0").select(F.concat(F.lit(" "), F.upper(F.get("w", F.lit(0))), F.lit(" "), F.get("w", F.lit(1)), F.lit(" ")).alias("alias"), F.col("top").alias("node"))
    return qlog.merged_aliases(own, other)


@query(
    "name_collisions",
    "select name, count(distinct kind) as kinds, count(*) as n from (select distinct name, kind, id from (select lower(stem) as name, 'file' as kind, path as id from code_files union all select lower(regexp_extract(unnest([top, folder]), '([^/]*)$', 1)), 'layer', unnest([top, folder]) from code_files union all select lower(split_part(replace(stem, '_', ' '), ' ', 1)), 'symbol', path from code_files union all select split_part(folder, '/', 2), 'symbol', path from code_files)) group by 1 having count(distinct kind) > 1",
    ("code_files",),
)
def name_collisions(spark, sf_dir):
    """Names that more than one kind of node has."""
    files = code_files(spark, sf_dir)
    layers = files.select(F.explode(F.array("top", "folder")).alias("id"))
    names = (
        files.select(F.lower("stem").alias("name"), F.lit("file").alias("kind"), F.col("path").alias("id"))
        .union(layers.select(F.lower(F.regexp_extract("id", "([^/]*)$", 1)), F.lit("layer"), "id"))
        .union(files.select(F.lower(F.substring_index(F.regexp_replace("stem", "_", " "), " ", 1)), F.lit("symbol"), "path"))
        .union(files.select(F.substring_index("folder", "/", -1), F.lit("symbol"), "path"))
    )
    return names.distinct().groupBy("name").agg(F.count_distinct("kind").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


#: Rows from which a page is asked for, and nodes of a packet.
OFFSET, MOST_NODES = 150, 200
PAGED = walk_sql(SEEDS, FORWARD, ", r as (select qid, id, depth, chain, row_number() over (partition by qid order by depth, chain) as n from best where depth > 0) ")


def reached_rows(spark, sf_dir):
    """The rows up to the last that a page can hold: each brings a node of its own, its end."""
    return graph.first_reached(starts(spark, sf_dir), most=OFFSET + MOST_NODES, **file_graph(spark, sf_dir))


@query("page_offset", PAGED + f"select qid, n, id from r where n > {OFFSET} and n <= {OFFSET + MOST_NODES}", ("seeds", "path_edges"), recursive=True)
def page_offset(spark, sf_dir):
    """The rows that follow an offset, in the order of the search."""
    return reached_rows(spark, sf_dir).where((F.col("n") > OFFSET) & (F.col("n") <= OFFSET + MOST_NODES)).select("qid", "n", "id")


@query(
    "page_chain_budget",
    PAGED + f""", t as (select qid, count(*) as total from r group by 1), p as (select * from r where n > {OFFSET}), seen as (select qid, node, min(n) as n from (select qid, unnest(chain[2:]) as node, n from p) group by 1, 2),
    cost as (select p.qid, p.n, count(s.node) as c from p left join seen s on p.qid = s.qid and p.n = s.n group by 1, 2),
    run as (select qid, n, 1 + sum(c) over (partition by qid order by n) as used from cost)
    select qid, count(*) as rows, cast(max(used) as bigint) as nodes, case when max(n) < any_value(total) then 'offset:' || max(n) end as continuation from run join t using (qid) where used <= {MOST_NODES} group by 1""",
    ("seeds", "path_edges"),
    recursive=True,
)
def page_chain_budget(spark, sf_dir):
    """How many rows fit a packet after an offset when each row brings the nodes of its chain that are not there yet, and where to go on."""
    rows = graph.cut(reached_rows(spark, sf_dir).select("qid", "n", "chain", "total"))
    total = rows.groupBy("qid").agg(F.max("total").alias("total"))
    page = rows.where(F.col("n") > OFFSET)
    first = page.select("qid", "n", F.explode(F.slice("chain", 2, F.size("chain"))).alias("node")).groupBy("qid", "node").agg(F.min("n").alias("n")).groupBy("qid", "n").agg(F.count("*").alias("c"))
    used = 1 + F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("qid").orderBy("n"))
    run = page.select("qid", "n").join(first, ["qid", "n"], "left").withColumn("used", used).where(F.col("used") <= MOST_NODES)
    told = run.groupBy("qid").agg(F.count("*").alias("rows"), F.max("used").cast("long").alias("nodes"), F.max("n").alias("last")).join(total, "qid")
    return told.select("qid", "rows", "nodes", F.when(F.col("last") < F.col("total"), F.concat(F.lit("offset:"), F.col("last").cast("string"))).alias("continuation"))


_asked = "asked as (select qid * 10 + k as qid, k, path, case k when 0 then 'DOWNSTREAM' when 1 then 'UPSTREAM' when 2 then 'LOCATE' else 'DOWNSTREAM' end as op from seeds, (select unnest(range(0, 4)) as k))"
_walk = lambda name, k, a, b: f"{name}(qid, id) using key (qid, id) as (select qid * 10 + {k}, path from seeds union select w.qid, p.{b} from {name} w join pairs p on w.id = p.{a} where not exists (select 1 from recurring.{name} r where r.qid = w.qid and r.id = p.{b}) group by 1, 2)"


@query(
    "answer_batch",
    f"with {_asked}, pairs as materialized (select distinct src, dst from path_edges where type <> 'realtime'), {_walk('down', 0, 'dst', 'src')}, {_walk('up', 1, 'src', 'dst')}, c as (select qid, count(*) as n from (select * from down union all select * from up) group by 1)"
    " select a.qid, op, case when k < 3 then path end as target, case when k < 3 then 'matched' else 'no-match' end as status, case when k = 3 then 0 when k = 2 then 1 else n end as n_nodes from asked a left join c using (qid)",
    ("seeds", "path_edges"),
    recursive=True,
)
def answer_batch(spark, sf_dir):
    """Packets of a batch: status, operation, target and number of rows, by parse, bind, decide and search."""
    files = code_files(spark, sf_dir).select("path", F.lower("path").alias("target"))
    s = seeds(spark, sf_dir)
    phrases = F.array(F.lit("What depends on %s?"), F.lit("dependencies of %s"), F.lit("where is %s"), F.lit("what uses %s.missing"))
    asked = s.select("qid", "path", F.posexplode(phrases).alias("k", "phrase")).select((F.col("qid") * 10 + F.col("k")).alias("qid"), F.replace("phrase", F.lit("%s"), "path").alias("question"))
    parsed = asked.select("qid", T.intent(T.normalize_question(F.col("question"))).alias("i")).select("qid", "i.op", F.regexp_replace("i.target", "^where is ", "").alias("target"))
    bound = graph.cut(parsed.join(files, "target", "left").select("qid", "op", "path"))
    go = lambda op, back: graph.search(bound.where((F.col("op") == op) & F.col("path").isNotNull()).select("qid", F.col("path").alias("id")), **file_graph(spark, sf_dir, reverse=back), chains=False)
    rows = go("DOWNSTREAM", True).unionByName(go("UPSTREAM", False)).groupBy("qid").agg(F.count("*").alias("n"))
    status = F.when(F.col("path").isNull(), "no-match").otherwise("matched")
    return bound.join(rows, "qid", "left").select("qid", "op", F.col("path").alias("target"), status.alias("status"), F.coalesce("n", F.when(F.col("path").isNull(), 0).otherwise(1)).cast("long").alias("n_nodes"))
