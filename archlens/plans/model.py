"""Queries of the model plane: sources, assignment, roll-ups, folders, differences, findings and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archlens.operators import assign, folders, manifest
from archlens.plans.base import query
from archlens.sources.tables import code_edges, code_files, group_edges, path_edges, refs, seeds, table

# Source extensions and excluded folders.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "sql")
EXCLUDED = (".git", "node_modules", ".venv", "venv", "__pycache__", "vendor", "dist", "artifacts", "build", ".next")
BRANDS = [f"brand{i}{j}" for i in range(1, 6) for j in range(1, 6)]
#: Every brand but the last two has a group; two more overlap with them, and one takes nothing.
SPEC = [{"id": b, "globs": [f"{b}/**"]} for b in BRANDS[:-2]] + [{"id": "small", "globs": ["brand1?/small/*.py"]}, {"id": "promo", "globs": ["brand[2-3]*/promo/*", "nothing/*"]}, {"id": "empty", "globs": ["empty/**"]}]
SPEC_SQL = "spec(ord, id, pattern, slashes) as (values " + ", ".join(f"({i}, '{g['id']}', '{x}', {x.count('/')})" for i, g in enumerate(SPEC) for x in g["globs"]) + ")"
OWNED_SQL = (
    "with " + SPEC_SQL + """, owned as (select distinct f.fid, f.path, s.ord, s.id from code_files f join spec s on
    case when ends_with(pattern, '/**') then starts_with(path, left(pattern, -2)) else path glob pattern and length(path) - length(replace(path, '/', '')) = slashes end),
    first_owner as (select path, arg_min(id, ord) as layer from owned group by path) """
)


def owned(spark, sf_dir):
    return assign.owners(code_files(spark, sf_dir), SPEC)


def layer_of(spark, sf_dir):
    return owned(spark, sf_dir).select("path", F.get("owners", F.lit(0)).alias("layer")).where("layer is not null")


@query("source_filter", f"select path, folder from code_files where regexp_extract(path, '[.]([^./]*)$', 1) in {EXTENSIONS} and len(list_intersect(string_split(folder, '/'), {list(EXCLUDED)})) = 0", ("code_files",))
def source_filter(spark, sf_dir):
    folders = F.split("folder", "/")
    return code_files(spark, sf_dir).where(F.regexp_extract("path", r"[.]([^./]*)$", 1).isin(*EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED)))).select("path", "folder")


@query(
    "inventory_counts",
    "select case when contains(text, chr(0)) then 'binary' else 'text' end as content_kind, lang, count(*) as files, cast(sum(octet_length(encode(text))) as bigint) as bytes, cast(sum(length(text) - length(replace(text, chr(10), ''))) as bigint) as line_count from documents group by all",
)
def inventory_counts(spark, sf_dir):
    kind = F.when(F.col("text").contains("\x00"), "binary").otherwise("text")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "documents").groupBy(kind.alias("content_kind"), "lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(newlines).cast("long").alias("line_count"))


@query("inventory_digest", "select doc_id as id, sha256(text) as sha256, cast(octet_length(encode(text)) as bigint) as bytes, 1 + length(text) - length(replace(text, chr(10), '')) as line_count from documents")
def inventory_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), (1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("line_count"))


@query("assign_groups", OWNED_SQL + "select path, layer from first_owner", ("code_files",))
def assign_groups(spark, sf_dir):
    return layer_of(spark, sf_dir)


@query("unmapped_files", OWNED_SQL + "select path from code_files where path not in (select path from owned)", ("code_files",))
def unmapped_files(spark, sf_dir):
    return owned(spark, sf_dir).where(F.size("owners") == 0).select("path")


@query("double_mapped", OWNED_SQL + "select path, string_agg(id, ',' order by ord) as owners, count(*) as n from owned group by path having count(*) > 1", ("code_files",))
def double_mapped(spark, sf_dir):
    return owned(spark, sf_dir).where(F.size("owners") > 1).select("path", F.array_join("owners", ",").alias("owners"), F.size("owners").cast("long").alias("n"))


@query(
    "rollup_edges",
    OWNED_SQL + "select a.layer as src, b.layer as dst, type, count(*) as weight, min(e.src || ' > ' || e.dst) as sample from path_edges e join first_owner a on e.src = a.path join first_owner b on e.dst = b.path where a.layer <> b.layer group by all",
    ("code_files", "path_edges"),
)
def rollup_edges(spark, sf_dir):
    return assign.rollup(path_edges(spark, sf_dir).select("src", "dst", "type"), layer_of(spark, sf_dir))


@query("rollup_refs", "select a.top as src, b.top as dst, count(*) as weight from refs join code_files a on src = a.fid join code_files b on dst = b.fid where type = 'import' and a.top <> b.top group by all", ("refs", "code_files"))
def rollup_refs(spark, sf_dir):
    """Imports with their multiplicity, which roll-ups of one language keep."""
    return path_edges(spark, sf_dir, refs(spark, sf_dir).where("type = 'import'")).where("src_top <> dst_top").groupBy(F.col("src_top").alias("src"), F.col("dst_top").alias("dst")).agg(F.count("*").alias("weight"))


ROUTES = [("/en/[id]", 0), ("/de/[id]", 1), ("/en", 2), ("/fr", 3), ("/es/100", 4), ("/[lang]/[id]", 5)]
ROUTES_SQL = "routes(route, ord) as (values " + ", ".join(f"('{r}', {o})" for r, o in ROUTES) + ")"


@query(
    "route_resolve",
    f"""with {ROUTES_SQL},
    r as (select route, ord, string_split(route, '/') as segs from routes),
    p as (select page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) as path from pages),
    q as (select page_id, path, string_split(path, '/') as segs from p),
    c as (select page_id, path, route, case when q.path = route then 0
        when len(q.segs) = len(r.segs) and list_bool_and(list_transform(range(1, len(r.segs) + 1), lambda i: q.segs[i] = r.segs[i] or starts_with(r.segs[i], '['))) then 1
        when starts_with(q.path, route || '/') then 2 end as tier, length(route) as n, ord from q, r),
    k as (select *, row_number() over (partition by page_id order by tier, case when tier = 2 then -n else 0 end, route) as rn from c where tier is not null)
    select p.page_id, p.path, k.route from p left join k on p.page_id = k.page_id and rn = 1""",
)
def route_resolve(spark, sf_dir):
    """Exact route, else one of as many segments with dynamic ones, else the longest prefix; the first by text on ties."""
    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("segs", F.split("path", "/"))
    options = []
    for route, _ in ROUTES:
        segs = route.split("/")
        fits = F.size("segs") == len(segs)
        for i, s in enumerate(segs):
            if not s.startswith("["):
                fits = fits & (F.get("segs", F.lit(i)) == s)
        tier = F.when(F.col("path") == route, 0).when(fits, 1).when(F.col("path").startswith(route + "/"), 2)
        options.append(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), F.when(tier == 2, -len(route)).otherwise(0).alias("n"), F.lit(route).alias("route"))))
    return pages.select("page_id", "path", F.array_min(F.array(*options))["route"].alias("route"))


@query("last_definition", "select name, path from (select o_orderpriority || '/' || o_orderstatus as name, max(strftime(o_orderdate, '%Y%m%d') || '_' || lpad(cast(o_orderkey as varchar), 10, '0')) as path from orders group by 1)")
def last_definition(spark, sf_dir):
    """Of several definitions of a name the one with the last path counts."""
    path = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return table(spark, sf_dir, "orders").groupBy(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("name")).agg(F.max_by(path, path).alias("path"))


@query("file_edges_distinct", "select src, dst, type, src_top <> dst_top as cross_layer from path_edges", ("path_edges",))
def file_edges_distinct(spark, sf_dir):
    return path_edges(spark, sf_dir).select("src", "dst", "type", (F.col("src_top") != F.col("dst_top")).alias("cross_layer"))


@query("dropped_edges", "select src, dst, type from code_edges where src not in (select fid from code_files where lines > 5) or dst not in (select fid from code_files where lines > 5)", ("code_files", "code_edges"))
def dropped_edges(spark, sf_dir):
    """Edges of which an end is not in the inventory (here: files of more than five lines)."""
    known = code_files(spark, sf_dir).where("lines > 5").select("fid")
    edges = code_edges(spark, sf_dir)
    kept = edges.join(known, edges["src"] == known["fid"], "left_semi").join(known, edges["dst"] == known["fid"], "left_semi")
    return edges.join(kept, ["src", "dst", "type"], "left_anti")


@query("external_packages", "select case when starts_with(spec, '@') then regexp_extract(spec, '^[^/]*(/[^/]*)?') else split_part(spec, '/', 1) end as package, count(*) as n from (select case when p_size % 3 = 0 then '@' else '' end || replace(p_type, ' ', '/') as spec from part) group by 1")
def external_packages(spark, sf_dir):
    spec = F.concat(F.when(F.col("p_size") % 3 == 0, "@").otherwise(""), F.regexp_replace("p_type", " ", "/"))
    package = F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    return table(spark, sf_dir, "part").groupBy(package.alias("package")).agg(F.count("*").alias("n"))


@query("importer_counts", "select dst as path, count(distinct src) as importers from path_edges where type = 'import' and src <> dst group by 1", ("path_edges",))
def importer_counts(spark, sf_dir):
    return path_edges(spark, sf_dir).where("type = 'import' and src <> dst").groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("importers"))


@query(
    "top_fan_in",
    """select layer, path, n, rank from (select top as layer, path, coalesce(n, 0) as n, row_number() over (partition by top order by coalesce(n, 0) desc, path) as rank
    from code_files left join (select dst as path, count(distinct src) as n from path_edges where type = 'import' and src <> dst group by 1) using (path)) where rank <= 5 and n > 0""",
    ("code_files", "path_edges"),
)
def top_fan_in(spark, sf_dir):
    """Five files of each group with most importers; zeros go after the cut."""
    n = importer_counts(spark, sf_dir)
    order = Window.partitionBy("layer").orderBy(F.desc("n"), "path")
    rows = code_files(spark, sf_dir).select(F.col("top").alias("layer"), "path").join(n, "path", "left").select("layer", "path", F.coalesce("importers", F.lit(0)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5 and n > 0")


@query("extractor_stats", "select * from (select 'in' as side, dst as path, count(*) as n from path_edges where type = 'import' group by dst order by n desc, path limit 15) union all select * from (select 'out' as side, src as path, count(distinct dst) as n from path_edges group by src order by n desc, path limit 10)", ("path_edges",))
def extractor_stats(spark, sf_dir):
    edges = path_edges(spark, sf_dir)
    first = edges.where("type = 'import'").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(15)
    second = edges.groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "path").limit(10)
    return first.select(F.lit("in").alias("side"), "path", "n").unionByName(second.select(F.lit("out").alias("side"), "path", "n"))


@query("edge_histogram", "select type, count(*) as n, cast(count_if(src_top <> dst_top) as bigint) as crossing from path_edges group by 1", ("path_edges",))
def edge_histogram(spark, sf_dir):
    return path_edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("src_top") != F.col("dst_top")).alias("crossing"))


@query("group_lines", OWNED_SQL + "select s.id as layer, count(f.path) as files, cast(coalesce(sum(f.lines), 0) as bigint) as lines from (select distinct id from spec) s left join first_owner o on s.id = o.layer left join code_files f on o.path = f.path group by 1", ("code_files",))
def group_lines(spark, sf_dir):
    """Files and lines of each group, empty ones too."""
    spec = spark.createDataFrame([(g["id"],) for g in SPEC], "layer string")
    files = owned(spark, sf_dir).select(F.get("owners", F.lit(0)).alias("layer"), "lines").groupBy("layer").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return spec.join(files, "layer", "left").select("layer", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query(
    "folder_tree",
    """select label, case when contains(label, '/') then regexp_replace(label, '/[^/]*$', '') end as parent, len(string_split(label, '/')) - 1 as depth,
    'folder-' || left(sha256(label), 16) as id from (select distinct unnest([top, folder]) as label from code_files)""",
    ("code_files",),
)
def folder_tree(spark, sf_dir):
    return assign.folders(code_files(spark, sf_dir)).select("label", "parent", F.col("depth").cast("long").alias("depth"), F.concat(F.lit("folder-"), F.substring(F.sha2("label", 256), 1, 16)).alias("id"))


@query("folder_descendants", "select unnest([top, folder]) as label, count(*) as files, count(distinct folder) as folders, min(path) as first_path from code_files group by 1", ("code_files",))
def folder_descendants(spark, sf_dir):
    return code_files(spark, sf_dir).select(F.explode(F.array("top", "folder")).alias("label"), "path", "folder").groupBy("label").agg(F.count("*").alias("files"), F.count_distinct("folder").alias("folders"), F.min("path").alias("first_path"))


DEEP = "deep as (select case when fid % 3 = 0 then top || '/only/' || split_part(folder, '/', 2) || '/x/' || stem else path end as path from code_files)"


@query(
    "folder_compact",
    f"""with {DEEP}, f as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as label from deep, (select unnest(range(1, 9)) as i) where i < len(string_split(path, '/'))),
    k as (select regexp_replace(label, '/[^/]*$', '') as label, count(*) as n, min(label) as only_child from f where contains(label, '/') group by 1),
    own as (select distinct regexp_replace(path, '/[^/]*$', '') as label from deep),
    step as (select label, label as shown from f union select s.label, only_child from step s join k on s.shown = k.label and n = 1 and s.shown not in (select label from own))
    select label, max(shown) as compact_label from step group by 1""",
    ("code_files",),
    recursive=True,
)
def folder_compact(spark, sf_dir):
    """A folder without files of its own whose only child is a folder is shown with it, along the whole chain."""
    deep = F.when(F.col("fid") % 3 == 0, F.concat("top", F.lit("/only/"), F.substring_index("folder", "/", -1), F.lit("/x/"), "stem")).otherwise(F.col("path"))
    return assign.compacted(code_files(spark, sf_dir).select(deep.alias("path")))


MANUAL = """manual as (select 'brand' || (n_nationkey + 1) as src, 'brand' || (n_regionkey + 20) as dst, 'manual' as type, 1 as weight, case when n_nationkey % 3 = 0 then '' else n_name end as why from nation where n_nationkey + 1 <> n_regionkey + 20)"""


def manual(spark, sf_dir):
    """Edges between groups that were drawn by hand: one for each nation, some without a reason."""
    nation = table(spark, sf_dir, "nation")
    why = F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name"))
    src, dst = (F.concat(F.lit("brand"), c.cast("string")) for c in (F.col("n_nationkey") + 1, F.col("n_regionkey") + 20))
    return assign.manual_edges(nation.select(src.alias("src"), dst.alias("dst"), why.alias("why")))


@query("manual_edges", f"with {MANUAL} select src, dst, type, weight, cast(null as varchar) as sample, why from manual")
def manual_edges(spark, sf_dir):
    return manual(spark, sf_dir)


@query("typed_group_edges", f"with {MANUAL} select src, dst, type, weight from group_edges union all select src, dst, type, weight from manual", ("group_edges",))
def typed_group_edges(spark, sf_dir):
    return group_edges(spark, sf_dir).unionByName(manual(spark, sf_dir).select("src", "dst", "type", F.col("weight").cast("long").alias("weight")))


OLD_NEW = """o as (select path, top, lines from code_files where fid % 10 <> 0), n as (select path, top, lines + case when fid % 7 = 0 then 1 else 0 end as lines from code_files where fid % 10 <> 1)"""


def old_new(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return files.where("fid % 10 <> 0").select("path", "top", "lines"), files.where("fid % 10 <> 1").select("path", "top", (F.col("lines") + F.when(F.col("fid") % 7 == 0, 1).otherwise(0)).alias("lines"))


@query("snapshot_diff", f"with {OLD_NEW} select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'changed' end as change from o full join n on o.path = n.path where o.path is null or n.path is null or o.lines <> n.lines", ("code_files",))
def snapshot_diff(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    both = old.select("path", F.col("lines").alias("was")).join(new.select("path", F.col("lines").alias("now")), "path", "full_outer")
    return both.where("was is null or now is null or was <> now").select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("changed").alias("change"))


@query("field_changes", f"with {OLD_NEW} select path, 'lines' as field, cast(o.lines as varchar) as was, cast(n.lines as varchar) as now from o join n using (path) where o.lines <> n.lines", ("code_files",))
def field_changes(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    both = old.select("path", F.col("lines").alias("a")).join(new.select("path", F.col("lines").alias("b")), "path").where("a <> b")
    return both.select("path", F.lit("lines").alias("field"), F.col("a").cast("string").alias("was"), F.col("b").cast("string").alias("now"))


@query(
    "diff_counts",
    f"""with {OLD_NEW}, eo as (select * from code_edges where src % 10 <> 0 and dst % 10 <> 0), en as (select * from code_edges where src % 10 <> 1 and dst % 10 <> 1)
    select 'added_files' as what, count(*) as n from n anti join o using (path) union all select 'deleted_files', count(*) from o anti join n using (path)
    union all select 'added_edges', count(*) from (select * from en except select * from eo) union all select 'deleted_edges', count(*) from (select * from eo except select * from en)""",
    ("code_files", "code_edges"),
)
def diff_counts(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    edges = code_edges(spark, sf_dir)
    before, after = edges.where("src % 10 <> 0 and dst % 10 <> 0"), edges.where("src % 10 <> 1 and dst % 10 <> 1")
    count = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n")).select("what", "n")
    return count("added_files", new.join(old, "path", "left_anti")).union(count("deleted_files", old.join(new, "path", "left_anti"))).union(count("added_edges", after.subtract(before))).union(count("deleted_edges", before.subtract(after)))


@query("edge_changes", "select 'added' as change, * from (select * from code_edges where src % 10 <> 1 except select * from code_edges where src % 10 <> 0) union all select 'deleted', * from (select * from code_edges where src % 10 <> 0 except select * from code_edges where src % 10 <> 1)", ("code_edges",))
def edge_changes(spark, sf_dir):
    edges = code_edges(spark, sf_dir)
    before, after = edges.where("src % 10 <> 0"), edges.where("src % 10 <> 1")
    return after.subtract(before).select(F.lit("added").alias("change"), "*").union(before.subtract(after).select(F.lit("deleted").alias("change"), "*"))


HREFS = """hrefs as (select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)"""


def hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))


@query("page_refs", f"with {HREFS} select h.page_id, href, p.url is not null as resolved from hrefs h left join pages p on h.href = p.url")
def page_refs(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("href"), F.lit(True).alias("known"))
    return hrefs(spark, sf_dir).join(urls, "href", "left").select("page_id", "href", F.coalesce("known", F.lit(False)).alias("resolved"))


CATEGORY = "case when href like '#%' then 'anchor' when href like 'http%' then 'external' else 'unresolved' end"


@query("trust_filter", f"with {HREFS} select page_id, href from hrefs where {CATEGORY} = 'unresolved' and contains(lower(href), 'the')")
def trust_filter(spark, sf_dir):
    return hrefs(spark, sf_dir).where((F.expr(CATEGORY) == "unresolved") & F.lower("href").contains("the"))


@query("scope_partition", "select path, case when top in ('brand11', 'brand22', 'brand33') then 'unscanned' else 'scanned' end as scope from code_files", ("code_files",))
def scope_partition(spark, sf_dir):
    files = code_files(spark, sf_dir).select("path", "top")
    out = files.where(F.col("top").isin("brand11", "brand22", "brand33")).select("path")
    return out.select("path", F.lit("unscanned").alias("scope")).union(files.select("path").join(out, "path", "left_anti").select("path", F.lit("scanned").alias("scope")))


@query(
    "violations_edges",
    """select 'dangling' as rule, cast(src as varchar) || '>' || cast(dst as varchar) as what from code_edges where dst not in (select fid from code_files where lines > 2) or src not in (select fid from code_files where lines > 2)
    union all select 'self', cast(src as varchar) || '>' || cast(dst as varchar) from code_edges where src = dst
    union all select 'duplicate', cast(src as varchar) || '>' || cast(dst as varchar) from refs group by src, dst, type having count(*) > 1""",
    ("code_files", "code_edges"),
)
def violations_edges(spark, sf_dir):
    edges, all_ = code_edges(spark, sf_dir), refs(spark, sf_dir)
    known = code_files(spark, sf_dir).where("lines > 2").select("fid")
    kept = edges.join(known, edges["src"] == known["fid"], "left_semi").join(known, edges["dst"] == known["fid"], "left_semi")
    what = F.concat_ws(">", "src", "dst").alias("what")
    return (
        edges.join(kept, ["src", "dst", "type"], "left_anti").select(F.lit("dangling").alias("rule"), what)
        .union(edges.where("src = dst").select(F.lit("self"), what))
        .union(all_.groupBy("src", "dst", "type").count().where("count > 1").select(F.lit("duplicate"), what))
    )


@query(
    "build_checks",
    OWNED_SQL + """, manual(src, dst) as (values ('brand11', 'brand12'), ('brand12', 'nowhere'))
    select name, n, n = 0 or starts_with(name, 'note') as ok from (
    select 'unresolved imports' as name, (select count(*) from path_edges where type = 'import' and dst in (select path from code_files where lines <= 1)) as n
    union all select 'unmapped', (select count(*) from code_files where path not in (select path from owned))
    union all select 'double mapped', (select count(*) from (select path from owned group by path having count(*) > 1))
    union all select 'empty group', (select count(*) from (select distinct id from spec) where id not in (select layer from first_owner))
    union all select 'group cycles', (select count(*) from (select distinct a.src from group_edges a join group_edges b on a.src = b.dst and a.dst = b.src where a.type = 'import' and b.type = 'import'))
    union all select 'manual edges', (select count(*) from manual where src not in (select id from spec) or dst not in (select id from spec))
    union all select 'dangling group edges', (select count(*) from group_edges where src not in (select top from code_files) or dst not in (select top from code_files))
    union all select 'dangling file edges', (select count(*) from code_edges where src not in (select fid from code_files) or dst not in (select fid from code_files))
    union all select 'note: dropped edges', (select count(*) from refs) - (select count(*) from code_edges)
    union all select 'note: self edges', (select count(*) from code_edges where src = dst))""",
    ("code_files", "code_edges", "path_edges", "group_edges"),
)
def build_checks(spark, sf_dir):
    """Eight checks that a map must pass, each with what it found, and notes."""
    files, edges, groups = owned(spark, sf_dir), code_edges(spark, sf_dir), group_edges(spark, sf_dir)
    spec = spark.createDataFrame([(g["id"],) for g in SPEC], "layer string")
    manual = spark.createDataFrame([("brand11", "brand12"), ("brand12", "nowhere")], "src string, dst string")
    lost = lambda df, known, key: df.join(known.select(F.col(key).alias("src")), "src", "left_anti").select("src", "dst").union(df.join(known.select(F.col(key).alias("dst")), "dst", "left_anti").select("src", "dst")).distinct()
    imports = groups.where("type = 'import'").select("src", "dst")
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    tops, fids = code_files(spark, sf_dir).select("top").distinct(), code_files(spark, sf_dir).select("fid")
    short = code_files(spark, sf_dir).where("lines <= 1").select(F.col("path").alias("dst"))
    found = {
        "unresolved imports": path_edges(spark, sf_dir).where("type = 'import'").join(short, "dst", "left_semi"),
        "unmapped": files.where(F.size("owners") == 0),
        "double mapped": files.where(F.size("owners") > 1),
        "empty group": spec.join(files.select(F.get("owners", F.lit(0)).alias("layer")), "layer", "left_anti"),
        "group cycles": imports.join(back, ["src", "dst"], "left_semi").select("src").distinct(),
        "manual edges": lost(manual, spec, "layer"),
        "dangling group edges": lost(groups.select("src", "dst"), tops, "top"),
        "dangling file edges": lost(edges.select("src", "dst"), fids, "fid"),
        "note: dropped edges": refs(spark, sf_dir).exceptAll(edges),
        "note: self edges": edges.where("src = dst"),
    }
    out = None
    for name, df in found.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n", ((F.col("n") == 0) | F.lit(name.startswith("note"))).alias("ok"))
        out = row if out is None else out.union(row)
    return out


MANIFEST = """line as (select doc_id::varchar as key, doc_id || ':' || sha256(text) as line from documents), leaf as (select left(sha256(key), 2) as place, sha256(string_agg(line, chr(10) order by key)) as digest, count(*) as n from line group by 1),
  inner_ as (select left(place, 1) as place, sha256(string_agg(place || ':' || digest, chr(10) order by place)) as digest, sum(n) as n from leaf group by 1),
  root as (select '' as place, sha256(string_agg(place || ':' || digest, chr(10) order by place)) as digest, sum(n) as n from inner_)"""


@query("manifest_digest", f"with {MANIFEST} select 2 as level, place, digest, n from leaf union all select 1, place, digest, cast(n as bigint) from inner_ union all select 0, place, digest, cast(n as bigint) from root")
def manifest_digest(spark, sf_dir):
    """The tree of digests of all documents: its root stands for the whole list, and no task holds the list."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.concat_ws(":", "doc_id", F.sha2("text", 256)).alias("line"))
    return manifest.tree(rows, 2)


@query("manifest_changes", f"with {OLD_NEW} select coalesce(o.path, n.path) as key, case when o.path is null then 'added' when n.path is null then 'deleted' else 'changed' end as state from o full join n on o.path = n.path where o.lines is distinct from n.lines", ("code_files",))
def manifest_changes(spark, sf_dir):
    """Lines that two manifests do not share, by comparing their trees from the roots."""
    old, new = old_new(spark, sf_dir)
    line = lambda df: df.select(F.col("path").alias("key"), F.concat_ws(":", "path", F.sha2(F.col("lines").cast("string"), 256)).alias("line"))
    return manifest.changes(line(old), line(new))


@query("mermaid_export", "select 'graph LR' || chr(10) || string_agg('  ' || src || ' --> ' || dst, chr(10) order by src, dst) as chart from (select distinct src, dst from group_edges where type <> 'realtime')", ("group_edges",))
def mermaid_export(spark, sf_dir):
    """The graph of groups as one chart."""
    edges = group_edges(spark, sf_dir).where("type <> 'realtime'").select("src", "dst").distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda e: F.concat(F.lit("  "), e["src"], F.lit(" --> "), e["dst"]))
    return edges.agg(F.concat(F.lit("graph LR\n"), F.array_join(lines, "\n")).alias("chart"))


@query("release_comparison", f"with {OLD_NEW} select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when sha256(cast(o.lines as varchar)) = sha256(cast(n.lines as varchar)) then 'same' else 'changed' end as state from o full join n on o.path = n.path", ("code_files",))
def release_comparison(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    digest = lambda df, name: df.select("path", F.sha2(F.col("lines").cast("string"), 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), "path", "full_outer")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


_folders = "folders_ as materialized (select distinct unnest([top, folder]) as label from code_files)"
_id = "'folder-' || left(sha256({}), 16)"


@query(
    "folder_listing",
    f"""with {_folders}, asked as (select qid * 2 + k as qid, case k when 0 then f.top else f.folder end as label from seeds s join code_files f using (path), (select unnest([0, 1]) as k)),
    found as (select qid, 0 as k, 'layer' as kind, {_id.format('f.label')} as id, [{_id.format('a.label')}, {_id.format('f.label')}] as ord from asked a join folders_ f on starts_with(f.label, a.label || '/')
      union all select qid, 1, 'file', path, [path] from asked join code_files on starts_with(path, label || '/'))
    select qid, row_number() over (partition by qid order by k, ord) as n, kind, id from found""",
    ("code_files", "seeds"),
)
def folder_listing(spark, sf_dir):
    """What lies in each asked folder, by intervals: folders level by level, then files."""
    files = code_files(spark, sf_dir)
    labels = F.array(F.struct(F.lit(0).alias("k"), F.col("top").alias("label")), F.struct(F.lit(1).alias("k"), F.col("folder").alias("label")))
    asked = seeds(spark, sf_dir).join(files, "path").select("qid", F.explode(labels).alias("l")).select((F.col("qid") * 2 + F.col("l.k")).alias("qid"), "l.label")
    return folders.listing(files, asked)


@query(
    "edges_collapsed",
    """with opened as (select qid as session, top as label from seeds s join code_files f using (path) union select qid, folder from seeds s join code_files f using (path) where qid % 2 = 1
      union select 100 + qid, folder from seeds s join code_files f using (path)),
    sessions as (select distinct session from opened),
    seen_ as materialized (select s.session, f.path, case when not exists (select 1 from opened o where o.session = s.session and o.label = f.top) then f.top
      when not exists (select 1 from opened o where o.session = s.session and o.label = f.folder) then f.folder else f.path end as seen from sessions s cross join code_files f)
    select a.session, a.seen as src, b.seen as dst, e.type, count(*) as weight from (select distinct src, dst, type from path_edges where type <> 'realtime') e
      join seen_ a on a.path = e.src join seen_ b on b.path = e.dst and b.session = a.session where a.seen <> b.seen group by all""",
    ("code_files", "seeds", "path_edges"),
)
def edges_collapsed(spark, sf_dir):
    """Edges between what each session sees, which opens some folders: a top folder, one in it too, or one whose top stays closed."""
    files = code_files(spark, sf_dir)
    mine = seeds(spark, sf_dir).join(files, "path").select("qid", "top", "folder")
    opened = mine.select(F.col("qid").alias("session"), F.col("top").alias("label")).unionByName(mine.where("qid % 2 = 1").select(F.col("qid").alias("session"), F.col("folder").alias("label")))
    opened = opened.unionByName(mine.select((100 + F.col("qid")).alias("session"), F.col("folder").alias("label")))
    return folders.collapsed(files, path_edges(spark, sf_dir), opened)
