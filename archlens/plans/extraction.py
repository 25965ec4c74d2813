"""Queries of the extraction plane over source trees that Spark writes from the code map.

For each file of the map there is a Python module, a script and a migration whose texts say what the map knows: imports, calls of
definitions, references over HTTP and to remote procedures. Extraction has to find the map again; the SQL takes it from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.operators import graph
from archlens.plans.base import query
from archlens.sources import extract
from archlens.sources.tables import code_edges, code_files

#: Names of remote procedures repeat: the last migration that defines one counts; some that are called are never defined.
DEFINED, CALLED = 500, 700


def linked(spark, sf_dir):
    """Each file with what it refers to by each type of edge, in order: arrays of (fid, module, script, top)."""
    files = code_files(spark, sf_dir).select("fid", "path", "stem", "top", "lines")
    other = files.select(F.col("fid").alias("dst"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"), F.concat_ws("/", F.lit(".."), "top", "stem").alias("script"), F.col("top").alias("to_top"))
    edges = code_edges(spark, sf_dir).where("src <> dst").join(other, "dst")
    told = F.struct("dst", "module", "script", "to_top")
    by = edges.groupBy(F.col("src").alias("fid")).agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == t, told))).alias(t) for t in ("import", "http", "rpc", "realtime")])
    none = F.array().cast("array<struct<dst:bigint,module:string,script:string,to_top:string>>")
    return files.join(by, "fid", "left").select("fid", "path", "stem", "top", "lines", *[F.coalesce(t, none).alias(t) for t in ("import", "http", "rpc", "realtime")])


def said(*lines):
    """Lines of a text; an array of lines stands for each of its own."""
    parts = [c if i == 1 else F.array(c) for c, i in lines]
    return F.concat(F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def one(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 0


def each(column, f):
    return F.transform(column, f), 1


def python_text():
    i = F.col("fid").cast("string")
    base = F.get(F.filter("import", lambda e: e["dst"] < F.col("fid")), F.lit(0))["dst"].cast("string")
    return said(
        one('"""About ', F.replace("stem", F.lit("_"), F.lit(" ")), '."""'), one("import os"),
        each("import", lambda e: F.concat(F.lit("from "), e["module"], F.lit(" import fn_"), e["dst"].cast("string"), F.lit(", C_"), e["dst"].cast("string"))),
        one("def fn_", i, "(x):"), one("    return os.fspath(x)"),
        (F.when(base.isNotNull(), F.concat(F.lit("class C_"), i, F.lit("(C_"), base, F.lit("):"))).otherwise(F.concat(F.lit("class C_"), i, F.lit(":"))), 0),
        one("    def load(self):"), one("        return self.read()"), one("    def read(self):"), one("        return fn_", i, "(1)"),
        one("def go_", i, "():"), one("    c = C_", i, "()"), one("    c.load()"), each("import", lambda e: F.concat(F.lit("    fn_"), e["dst"].cast("string"), F.lit("(2)"))),
        (F.when(F.col("fid") % 5 == 0, F.lit("    __import__('x' + 'y')")), 0), (F.when(F.col("fid") % 7 == 0, F.lit("    sys.path.append('lib')")), 0),
    )


def script_text():
    i = F.col("fid").cast("string")
    return said(
        one("// About ", F.replace("stem", F.lit("_"), F.lit(" ")), ","), one("//   written from the map"), one("import React from 'react'"),
        each("import", lambda e: F.concat(F.lit("import { fn_"), e["dst"].cast("string"), F.lit(" } from '"), e["script"], F.lit("'"))),
        one("// import x from './comment'"), one("const s = \"import y from './string'\""),
        each("http", lambda e: F.concat(F.lit("fetch('/api/"), e["to_top"], F.lit("/"), e["dst"].cast("string"), F.lit("')"))),
        each("rpc", lambda e: F.concat(F.lit("db.rpc('rpc_"), (e["dst"] % CALLED).cast("string"), F.lit("')"))),
        each("realtime", lambda e: F.concat(F.lit("import('./gone_"), e["dst"].cast("string"), F.lit("'); import( name_"), e["dst"].cast("string"), F.lit(" )"))),
        one("export function run_", i, "() {}"),
    )


def sources(spark, sf_dir):
    """(path, text): a module, a script and a migration for each file; an index of modules and a handler for each group."""
    rows = graph.cut(linked(spark, sf_dir))
    number, i = F.lpad(F.col("fid").cast("string"), 9, "0"), F.col("fid").cast("string")
    python = rows.select("path", python_text().alias("text"))
    script = rows.select(F.concat(F.lit("web/"), "top", F.lit("/"), "stem", F.lit(".ts")).alias("path"), script_text().alias("text"))
    sql = rows.select(F.concat(F.lit("db/migrations/"), number, F.lit(".sql")).alias("path"), F.concat(F.lit("CREATE OR REPLACE FUNCTION app.rpc_"), (F.col("fid") % DEFINED).cast("string"), F.lit("() returns int as $$ select "), i, F.lit(" $$;\n")).alias("text"))
    first = rows.groupBy("top").agg(F.min(F.struct("path", "fid")).alias("f")).select("top", "f.*")
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    inner = first.select(F.concat(F.lit("pkg/"), "top", F.lit("/__init__.py")).alias("path"), F.concat(F.lit("from "), module, F.lit(" import fn_"), F.col("fid").cast("string"), F.lit(" as first\n")).alias("text"))
    line = F.concat(F.lit("from pkg."), "top", F.lit(" import first as first_"), "top")
    outer = first.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).select(F.lit("pkg/__init__.py").alias("path"), F.concat("text", F.lit("\n")).alias("text"))
    odd = F.substring("top", F.lit(6), F.lit(9)).cast("int") % 2 == 1
    route = first.select(F.concat(F.lit("app/api/"), "top", F.when(odd, "/[id]").otherwise(""), F.lit("/route.ts")).alias("path"), F.lit("export async function GET() {}\nexport { helper as h, x }\n").alias("text"))
    return graph.cut(python.unionByName(script).unionByName(sql).unionByName(inner).unionByName(outer).unionByName(route))


def layers(files):
    """(path, layer): scripts by their group, handlers and data as one; Python has none."""
    kind = F.when(F.col("path").startswith("web/"), F.get(F.split("path", "/"), F.lit(1))).when(F.col("path").startswith("app/api/"), "api").when(F.col("path").startswith("db/"), "data")
    return files.select("path", kind.alias("layer")).where("layer is not null")


#: The same tree for DuckDB: edges between different files, and how long the parts of a module are.
TREE = """links as materialized (select src, dst, type from code_edges where src <> dst),
  f as materialized (select c.*, 'web/' || top || '/' || stem || '.ts' as script, 'db/migrations/' || lpad(fid::varchar, 9, '0') || '.sql' as sql, coalesce(n, 0) as n, base
    from code_files c left join (select src, count(*) as n, min(dst) filter (dst < src) as base from links where type = 'import' group by 1) on src = fid),
  firsts as materialized (select top, min(path) as path, arg_min(fid, path) as fid from f group by top)"""
VIEWS = ("code_files", "code_edges")
SCRIPTS = "select a.script as path, b.script as other, dst, type, b.top from links join f a on a.fid = src join f b on b.fid = dst"


@query(
    "extract_imports",
    f"""with {TREE}, s as ({SCRIPTS}), every as (
      select path as src, other as dst, 'import' as kind from s where type = 'import' union all select script, 'react', 'external' from f union all select path, 'UNRESOLVED:./gone_' || dst, 'unresolved' from s where type = 'realtime'
      union all select a.path, b.path, 'import' from links join f a on a.fid = src join f b on b.fid = dst where type = 'import' union all select path, 'os', 'external' from f
      union all select 'pkg/' || top || '/__init__.py', path, 'import' from firsts union all select 'pkg/__init__.py', 'pkg/' || top || '/__init__.py', 'import' from firsts)
    select src, dst, kind, count(*) as n from every group by all""",
    VIEWS,
)
def extract_imports(spark, sf_dir):
    """Import edges of both languages, resolved, external and unresolved; scripts count each place, Python each pair."""
    files = sources(spark, sf_dir)
    both = extract.resolve_specifiers(extract.js_specifiers(files), files).unionByName(extract.python_imports(files))
    return both.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query("dynamic_imports", f"with {TREE}, s as ({SCRIPTS}) select path, 'import' as call, 'name_' || dst as argument from s where type = 'realtime'", VIEWS)
def dynamic_imports(spark, sf_dir):
    """Requires and imports of what is no literal."""
    return extract.dynamic_imports(sources(spark, sf_dir))


@query(
    "python_findings",
    f"with {TREE} select path, 'dynamic Python import' as kind, '__import__' as name, 2 * n + 13 - 1 + 1 as line from f where fid % 5 = 0 union all select path, 'search path not modelled', 'sys.path.append', 2 * n + 13 + case when fid % 5 = 0 then 1 else 0 end from f where fid % 7 = 0",
    VIEWS,
)
def python_findings(spark, sf_dir):
    """Dynamic imports and changes of the search path that are not modelled."""
    return extract.python_facts(sources(spark, sf_dir)).where("fact = 'unsupported'").select("path", "kind", "name", "line")


@query(
    "extract_symbols",
    f"""with {TREE} select path, name, kind, start, "end", parent from (select path, unnest([
      {{'name': 'fn_' || fid, 'kind': 'function', 'start': n + 3, 'end': n + 4, 'parent': null}}, {{'name': 'C_' || fid, 'kind': 'class', 'start': n + 5, 'end': n + 9, 'parent': null}},
      {{'name': 'C_' || fid || '.load', 'kind': 'method', 'start': n + 6, 'end': n + 7, 'parent': 'C_' || fid}}, {{'name': 'C_' || fid || '.read', 'kind': 'method', 'start': n + 8, 'end': n + 9, 'parent': 'C_' || fid}},
      {{'name': 'go_' || fid, 'kind': 'function', 'start': n + 10, 'end': 2 * n + 12 + case when fid % 5 = 0 then 1 else 0 end + case when fid % 7 = 0 then 1 else 0 end, 'parent': null}}], recursive := true) from f)""",
    VIEWS,
)
def extract_symbols(spark, sf_dir):
    return extract.python_facts(sources(spark, sf_dir)).where("fact = 'symbol'").select("path", "name", "kind", F.col("line").alias("start"), F.col("end_line").alias("end"), "parent")


@query(
    "call_tiers",
    f"""with {TREE}, k as (select path || '#' as p, fid, n from f), called as (select a.path || '#go_' || src as src, b.path || '#fn_' || dst as dst, a.n + 12 + row_number() over (partition by src order by dst) as line
        from links join f a on a.fid = src join f b on b.fid = dst where type = 'import')
    select p || 'C_' || fid || '.load' as src, p || 'C_' || fid || '.read' as dst, 'resolved' as confidence, (n + 7)::varchar as sites from k
    union all select p || 'C_' || fid || '.read', p || 'fn_' || fid, 'resolved', (n + 9)::varchar from k union all select p || 'go_' || fid, p || 'C_' || fid, 'resolved', (n + 11)::varchar from k
    union all select p || 'go_' || fid, p || 'C_' || fid || '.load', 'instance-local', (n + 12)::varchar from k union all select src, dst, 'resolved', line::varchar from called""",
    VIEWS,
)
def call_tiers(spark, sf_dir):
    """Call edges with the confidence tier of each."""
    return extract.call_edges(extract.python_facts(sources(spark, sf_dir)))


@query(
    "class_linearization",
    f"""with {TREE}, up(fid, node, position) as (select fid, fid, 0 from f union all select u.fid, f.base, position + 1 from up u join f on f.fid = u.node where f.base is not null)
    select a.path || '#C_' || a.fid as class, position, b.path || '#C_' || b.fid as ancestor from up join f a on a.fid = up.fid join f b on b.fid = node""",
    VIEWS,
    recursive=True,
)
def class_linearization(spark, sf_dir):
    """The order in which a class and its ancestors are searched."""
    return extract.linearizations(extract.python_facts(sources(spark, sf_dir)))


@query(
    "python_exports",
    f"""with {TREE} select replace(regexp_replace(a.path, '[.]py$', ''), '/', '.') as module, c || dst as name, b.path, c || dst as symbol, 1 as hops from links join f a on a.fid = src join f b on b.fid = dst, (select unnest(['fn_', 'C_']) as c) where type = 'import'
    union all select 'pkg.' || top, 'first', path, 'fn_' || fid, 1 from firsts union all select 'pkg', 'first_' || top, path, 'fn_' || fid, 2 from firsts""",
    VIEWS,
)
def python_exports(spark, sf_dir):
    """Names that a module passes on from another, with the number of hops."""
    return extract.exports(extract.python_facts(sources(spark, sf_dir))).where("hops > 0").select("module", "name", "path", "symbol", "hops")


HANDLER = "case when cast(substr({0}, 6) as int) % 2 = 1 then 'app/api/' || {0} || '/[id]/route.ts' else 'app/api/' || {0} || '/route.ts' end"
REFERENCES = f"""s as ({SCRIPTS}), last as (select fid % {DEFINED} as r, max(sql) as sql from f group by 1),
  http as (select distinct path, '/api/' || top || '/' || dst as name, {HANDLER.format('top')} as definition from s where type = 'http'),
  rpc as (select distinct path, 'rpc_' || dst % {CALLED} as name, sql as definition from s left join last on r = dst % {CALLED} where type = 'rpc')"""


@query("rpc_definitions", f"with {TREE}, {REFERENCES} select path, 'http' as kind, name, definition from http union all select path, 'rpc', name, definition from rpc", VIEWS)
def rpc_definitions(spark, sf_dir):
    """HTTP and RPC references with the handler or the definition that counts, the last by path."""
    files = sources(spark, sf_dir)
    http = extract.routed(extract.http_references(files), files).select("path", F.lit("http").alias("kind"), F.col("url").alias("name"), F.col("route").alias("definition"))
    return http.unionByName(extract.rpc_references(files).select("path", F.lit("rpc").alias("kind"), "name", "definition"))


@query("sql_definitions", f"with {TREE} select 'rpc_' || fid % {DEFINED} as name, max(sql) as definition from f group by 1", VIEWS)
def sql_definitions(spark, sf_dir):
    """Functions that migrations define, the last by path."""
    return extract.sql_functions(sources(spark, sf_dir))


@query(
    "boundary_rollup",
    f"""with {TREE}, {REFERENCES}, every as (select 'http' as type, split_part(path, '/', 2) as src, 'api' as dst, path, name, name as shown, null as why from http
      union all select 'rpc', split_part(path, '/', 2), 'data', path, name, definition, '.rpc(''' || name || ''')' from rpc where definition is not null)
    select src, dst, type, count(*) as weight, arg_min(path || ' > ' || shown, (path, name)) as sample, arg_min(why, (path, name)) as why from every group by 1, 2, 3""",
    VIEWS,
)
def boundary_rollup(spark, sf_dir):
    """HTTP and RPC links between groups."""
    files = sources(spark, sf_dir)
    return extract.boundary_edges(files, layers(files))[0]


@query("boundary_misses", f"with {TREE}, {REFERENCES} select 'rpc' as type, path, name as target from rpc where definition is null", VIEWS)
def boundary_misses(spark, sf_dir):
    """References without a handler or definition."""
    files = sources(spark, sf_dir)
    return extract.boundary_edges(files, layers(files))[1]


@query(
    "file_descriptions",
    f"""with {TREE} select path, 'About ' || replace(stem, '_', ' ') || '.' as descr from f union all select script, 'About ' || replace(stem, '_', ' ') || ', written from the map' from f union all select sql, 'exports: rpc_' || fid % {DEFINED} from f
    union all select {HANDLER.format('top')}, 'exports: GET, h, x' from firsts union all select 'pkg/' || top || '/__init__.py', '' from firsts union all select 'pkg/__init__.py', ''""",
    VIEWS,
)
def file_descriptions(spark, sf_dir):
    return extract.descriptions(sources(spark, sf_dir))
