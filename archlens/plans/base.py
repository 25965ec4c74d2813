"""How a query registers, and the DuckDB side of the views that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "code_files": """select p_partkey as fid, top || '/' || mid || '/' || stem || '.py' as path, top || '/' || mid as folder, stem, top, p_size as lines
        from (select *, lower(replace(p_brand, '#', '')) as top, lower(split_part(p_type, ' ', 1)) as mid, replace(p_name, ' ', '_') || '_' || p_partkey as stem from part)""",
    "refs": """select o_custkey % n as src, o_orderkey % n as dst, case when o_orderpriority like '5%' and o_orderstatus = 'P' then 'realtime'
        when o_orderstatus = 'F' then 'import' when o_orderstatus = 'O' then 'http' else 'rpc' end as type from orders, (select count(*) as n from part)""",
    "code_edges": "select distinct src, dst, type from refs",
    "path_edges": """select a.path as src, b.path as dst, type, a.top as src_top, b.top as dst_top, a.folder as src_folder, b.folder as dst_folder
        from code_edges join code_files a on src = a.fid join code_files b on dst = b.fid""",
    "group_edges": "select src_top as src, dst_top as dst, type, count(*) as weight from path_edges where src_top <> dst_top group by all",
    "seeds": "select row_number() over (order by path) as qid, path from (select min(path) as path from code_files group by top)",
    "code_symbols": """select fid as sid, path || '#' || split_part(stem, '_', 1) || '@1' as id, split_part(stem, '_', 1) as name, regexp_replace(stem, '_[0-9]+$', '') as qualname, path,
        lines % 5 = 0 as decorated, lines % 10 = 0 as entry_point, lines from code_files""",
    "call_sites": """select a.id as src, case when l_linenumber < 7 then b.id end as dst, case when l_linenumber <= 3 then 'resolved' when l_linenumber = 4 then 'instance-local'
        when l_linenumber = 5 then 'typed' when l_linenumber = 6 then 'through-decorator' else 'unresolved' end as confidence, a.path, cast(1 + l_quantity as integer) as line, l_orderkey as position
        from lineitem join code_symbols a on l_partkey = a.sid join code_symbols b on l_orderkey % (select count(*) from part) = b.sid""",
    "call_edges": """select src, dst, max(list_position(['resolved', 'instance-local', 'typed', 'through-decorator'], confidence)) as tier from call_sites where dst is not null group by 1, 2""",
}
NEEDS = {"code_edges": ["refs"], "path_edges": ["code_files", "code_edges"], "group_edges": ["path_edges"], "seeds": ["code_files"], "code_symbols": ["code_files"], "call_sites": ["code_symbols"], "call_edges": ["call_sites"]}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """sql after the definitions of the views it names and those they need."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    head = ", ".join(f"{v} as materialized ({VIEWS[v]})" for v in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return f"with {'recursive ' if recursive else ''}{head + ', ' if head else ''}{body}"
    return f"with {head} {body}" if head else body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, recursive=recursive)
        return f

    return register


def greedy_sql(rows: str, group: str, key: str, size: str, budget: int) -> str:
    """(group, kept) of rows(group, key, size): in order of key, each that still fits; DuckDB folds a list of one-element parts."""
    return f"""select {group}, unnest(kept.k) as kept from (select {group}, list_reduce(list({{'u': cast({size} as bigint), 'k': [{key}]}} order by {key}), lambda a, x: case when a.u + x.u <= {budget} then {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} else a end, {{'u': 0::bigint, 'k': []}}) as kept from ({rows}) group by 1)"""
