"""Queries of whole answers: packets of a batch of questions about files, groups and definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archlens.operators import graph, packets, scoring
from archlens.plans.base import query
from archlens.plans.checks import PACKETS
from archlens.plans.checks import packets as dependents_packets
from archlens.plans.scoring import NODES_SQL, TEXTS, _name, _pairs, finish_sql, learned, nodes, prior, resolution_sql, scorer_sql
from archlens.plans.text import NORMAL
from archlens.sources.tables import code_files, code_symbols, group_edges, numbered_sites, refs, seeds, symbol_ids

#: Questions about each question's file, its group, its definition and the next question's file; then every text of the scorer.
QUESTIONS = (
    "What depends on {path}?", "dependencies of {stem}", "from {path} to {other}", "path between {path} and {top}", "callers of {path}", "callers of {qual}", "callees of {qual}",
    "what depends on the {top} folder?", "upstream of brand {number}", "what uses {typo}.py", "locate function {qual}", "where is {stem} called from", *TEXTS,
)
FILLED = {
    "path": ("path", "path"), "stem": ("stem", "stem"), "first": ("split_part(stem, '_', 1)", "first"), "second": ("split_part(stem, '_', 2)", "second"), "top": ("top", "top"),
    "number": ("substr(top, 6)", "number"), "folder": ("folder", "folder"), "last": ("split_part(folder, '/', 2)", "last"), "typo": ("left(stem, 2) || 'z' || substr(stem, 3)", "typo"),
    "qual": ("path || ':' || regexp_replace(stem, '_[0-9]+$', '')", "qual"), "other": ("other", "other"),
}


def asked(spark, sf_dir):
    """(qid, question): every template for the first file of each group."""
    s = seeds(spark, sf_dir)
    after = s.select((F.col("qid") - 1).alias("qid"), F.col("path").alias("other"))
    rows = s.join(after, "qid", "left").withColumn("other", F.coalesce("other", "path")).join(code_files(spark, sf_dir), "path")
    part = lambda c, i, by: F.coalesce(F.get(F.split(c, by), F.lit(i)), F.lit(""))
    values = {
        "first": part("stem", 0, "_"), "second": part("stem", 1, "_"), "number": F.substring("top", F.lit(6), F.lit(9)), "last": part("folder", 1, "/"),
        "typo": F.concat(F.substring("stem", 1, 2), F.lit("z"), F.substring("stem", F.lit(3), F.lit(999))), "qual": F.concat("path", F.lit(":"), F.regexp_replace("stem", "_[0-9]+$", "")),
    }
    rows = graph.cut(rows.withColumns(values)).select("*", F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("k", "t"))
    said = F.col("t")
    for name in FILLED:
        said = F.replace(said, F.lit("{" + name + "}"), F.col(name))
    return rows.select((F.col("qid") * 100 + F.col("k")).alias("qid"), said.alias("question"))


def packets_of(spark, sf_dir):
    files = code_files(spark, sf_dir)
    # Ends of edges and calls are numbers, even ones of files and odd ones of groups: ids of many files are long to shuffle.
    groups = graph.cut(group_edges(spark, sf_dir).select("src", "dst", "type"))
    layers = groups.select(F.col("src").alias("id")).union(groups.select("dst")).distinct().select((2 * F.row_number().over(Window.orderBy("id")) + 1).cast("long").alias("key"), "id")
    a, b = (layers.select(F.col("id").alias(e), F.col("key").alias(f"{e}_key")) for e in ("src", "dst"))
    groups = groups.join(a, "src").join(b, "dst").select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), "type")
    edges = refs(spark, sf_dir).select((2 * F.col("src")).alias("src"), (2 * F.col("dst")).alias("dst"), "type").unionByName(groups)
    names = files.select((2 * F.col("fid")).alias("key"), F.col("path").alias("id")).where("id is not null").unionByName(layers)
    index = graph.wide(graph.cut(scoring.indexed(nodes(spark, sf_dir))))
    symbols = graph.wide(graph.cut(code_symbols(spark, sf_dir).select("id", "name", "qualname", "path")))
    kept = files.select("path", F.sha2("path", 256).alias("sha256"))
    calls, ids = numbered_sites(spark, sf_dir), symbol_ids(spark, sf_dir)
    return packets.answer_packets(asked(spark, sf_dir), index, edges, symbols, calls, learned(spark), prior(spark, sf_dir), inventory=kept, names=names, call_names=ids)


_list = ", ".join("'" + t.replace("'", "''") + "'" for t in QUESTIONS)
_said = "t"
for _f, (_sql, _) in FILLED.items():
    _said = f"replace({_said}, '{{{_f}}}', {_sql})"
_asked = f"""select qid * 100 + k as qid, {_said} as question from (select qid, f.*, other from (select qid, path, coalesce(lead(path) over (order by qid), path) as other from seeds) s
  join code_files f using (path)), (select unnest([{_list}]) as t, unnest(range(0, {len(QUESTIONS)})) as k)"""
#: Texts without a match, each with one word replaced by its synonyms.
_variants = f"""base as (select qid, text from hopeless), syn(word, into_, ord) as (values {_pairs}),
cut as (select qid, text, unnest(string_split(text, ' ')) as word, unnest(range(1, len(string_split(text, ' ')) + 1)) as place from base),
made as (select qid, row_number() over (partition by qid order by place, ord) as n,
  array_to_string(list_transform(string_split(text, ' '), lambda w, i: case when i = place then into_ else w end), ' ') as text from cut join syn using (word)),
texts as materialized (select qid * 100 + n as qid, text from made where n <= 16)"""
_mapped = "case op " + " ".join(f"when '{a}' then '{b}'" for a, b in scoring.FOR_FILES.items()) + " else op end"
_walk = lambda name, ops, a, b: f"""{name}(id, node, depth, chain) using key (id, node) as (select distinct ids[1], ids[1], 0, [ids[1]] from go where plane = 'files' and op in {ops}
  union select w.id, p.{b}, any_value(w.depth) + 1, min(list_append(w.chain, p.{b})) from {name} w join pairs p on w.node = p.{a}
  where not exists (select 1 from recurring.{name} r where r.id = w.id and r.node = p.{b}) group by 1, 2)"""  # noqa: E731

ANSWERS = f"""with asked as materialized ({_asked}),
res as materialized (with {NODES_SQL}, {resolution_sql("select qid, question from asked")} select qid, op, file_op, outcome, choice, single, normal, i_target, by_symbol, intent, q_hint, ends from z),
lookup as materialized (select key, list_sort(list(id)) as ids from (select distinct id, {NORMAL.format('k')} as key from (select id, unnest([id, name, qualname, path || ':' || qualname]) as k from code_symbols)) group by key),
rest as materialized (select *, {_name("regexp_replace(name, '^the\\s+', '')")} as short from (select *, case when by_symbol then ends[1] else {_name('normal')} end as name from res where outcome = 'scored')),
said as materialized (select * from (select r.qid, not by_symbol as guessed, case when a.ids is not null then name else short end as text, coalesce(a.ids, b.ids, []) as ids
  from rest r left join lookup a on a.key = name left join lookup b on b.key = short) where not guessed or len(ids) > 0),
reads as (select qid, case when by_symbol then [i_target] else ends end as read from rest),
ends_ as materialized (select qid * 10 + place as qid, text from (select qid, unnest(read) as text, unnest(range(len(read))) as place from reads) union all select qid * 10 + 5, text from said),
texts_ as materialized (select * from ends_ where text is not null),
literal as materialized ({scorer_sql("texts as materialized (select qid, text from texts_)")} {finish_sql("scored", "fin")} select * from fin),
hopeless as materialized (select * from texts_ where qid not in (select qid from literal where label <> 'No match')),
again as materialized ({scorer_sql(_variants, variants=True)} {finish_sql("scored", "fin")} select * from fin),
won as (select qid // 100 as qid, idx, id, max_by(score, (score, -(qid % 100))) * 0.75 as score, max_by(case when missing then 'fuzzy' else kind_of end, (score, -(qid % 100))) as tier, max_by(covered, (score, -(qid % 100))) as coverage
  from (select *, max(case when rank = 1 then coverage end) over (partition by qid) as covered, max(case when rank = 1 then tier end) over (partition by qid) as kind_of from again) where suggested group by 1, 2, 3),
tried as (select qid, idx, id, score, score as evidence, coverage, tier, false as exact, 'architecture' as mode, false as missing, 'synonym' as branch from won),
{finish_sql("tried", "syn_")},
ranked as materialized (select qid, idx, id, score, tier, missing, rank, label, yes, suggested from literal where label <> 'No match' union all select qid, idx, id, score, tier, missing, rank, label, yes, suggested from syn_),
heads as materialized (select t.qid // 10 as qid, t.qid % 10 as place, coalesce(any_value(label), 'No match') as label, coalesce(any_value(yes), false) as yes, any_value(case when rank = 1 and score > 0 then id end) as choice,
  coalesce(any_value(case when rank = 1 then tier end), 'lexical') as tier, coalesce(any_value(case when rank = 1 then missing end), false) as missing, coalesce(list(id order by score desc, idx) filter (suggested), []) as offers
  from texts_ t left join ranked f using (qid) group by t.qid),
tops as (select qid, bool_and(yes) as yes, bool_or(missing) as missing, bool_and(label = 'No match' or tier = 'fuzzy') as poor, list(choice order by place) as ids, flatten(list(offers order by place)) as offers from heads where place < 5 group by 1),
{NODES_SQL.replace("nodes as", "nodes_ as", 1)},
named as (select s.*, r.q_hint as hint, r.by_symbol, h.choice, h.yes, h.offers, h.missing, case when by_symbol then r.op when coalesce(r.q_hint, '') = 'symbol' or t.poor then 'LOCATE' end as s_op,
    s.text in (select unnest([id, path, label]) from nodes_ where id <> '') or ((len(s.ids) = 0 or coalesce(r.q_hint in ('file', 'layer'), false)) and not (h.label = 'No match' or h.tier = 'fuzzy') and not h.missing) as other
  from said s join rest r using (qid) join tops t using (qid) join heads h on h.qid = s.qid and h.place = 5),
judged as materialized (select *, s_op is not null and other and not (coalesce(hint, '') = 'symbol' and (s_op <> 'LOCATE' or len(ids) > 0)) as legacy from named),
calls_ as materialized (select qid, s_op, ids from judged where s_op is not null and not legacy and (s_op <> 'LOCATE' or len(ids) > 0)),
mapped as materialized (select qid, s_op as op, yes, choice, offers from judged where legacy and s_op <> 'LOCATE'),
bound as materialized (
  select qid, 'symbols' as plane, s_op as op, case when len(ids) > 1 then 'needs-choice' when len(ids) = 0 then 'no-match' else 'bound' end as state, case when len(ids) = 1 then ids else [] end as ids, case when len(ids) > 1 then ids else [] end as offers, false as scored from calls_
  union all select r.qid, 'files', r.intent, case when yes then 'bound' when len(offers) > 0 then 'needs-choice' else 'no-match' end, case when yes then ids else [] end, case when yes then [] else list_filter(offers, lambda x, i: list_position(offers, x) = i) end, true
    from rest r join tops using (qid) where r.qid not in (select qid from calls_) and r.qid not in (select qid from mapped)
  union all select qid, 'files', {_mapped}, case when yes then 'bound' when len(offers) > 0 then 'needs-choice' else 'no-match' end, case when yes then [choice] else [] end, case when yes then [] else offers end, true from mapped
  union all select qid, case when outcome = 'symbols' then 'symbols' else 'files' end, case when outcome = 'files' then {_mapped} else op end, case when outcome in ('symbols', 'files') then 'bound' else outcome end,
    case when outcome in ('symbols', 'files') then single else [] end, case when outcome = 'needs-choice' then choice else [] end, false from res where outcome not in ('scored', 'unresolved')),
kinds as (select id, kind from nodes_ union all select id, 'symbol' from code_symbols),
fit as materialized (select b.* replace (case when state = 'bound' and len(ids) = 2 and a.kind <> c.kind then 'unsupported' else state end as state) from bound b left join kinds a on a.id = ids[1] left join kinds c on c.id = ids[2]),
go as materialized (select * from fit where state = 'bound'),
links as materialized (select src, dst, type from path_edges where type <> 'realtime' union select src, dst, type from group_edges where type <> 'realtime'),
pairs as materialized (select distinct src, dst from links),
{_walk("up", "('UPSTREAM', 'PATH')", "src", "dst")}, {_walk("down", "('DOWNSTREAM', 'X')", "dst", "src")},
found as materialized (select g.qid, node as id, depth, chain from go g join up on up.id = ids[1] where plane = 'files' and op = 'UPSTREAM' and depth > 0
  union all select g.qid, node, depth, chain from go g join down on down.id = ids[1] where plane = 'files' and op = 'DOWNSTREAM' and depth > 0
  union all select g.qid, node, depth, chain from go g join up on up.id = ids[1] and node = ids[2] where plane = 'files' and op = 'PATH'
  union all select distinct g.qid, c.src, 1, [ids[1], c.src] from go g join call_edges c on c.dst = ids[1] and c.src <> c.dst where plane = 'symbols' and op = 'CALLERS'
  union all select distinct g.qid, c.dst, 1, [ids[1], c.dst] from go g join call_edges c on c.src = ids[1] and c.src <> c.dst where plane = 'symbols' and op = 'CALLEES'),
numbered as (select *, row_number() over w as n, count(*) over (partition by qid) as total, 3 * sum(list_sum(list_transform(chain, lambda c: strlen(c) + 12))) over w as bytes from found window w as (partition by qid order by depth, chain)),
shown as materialized (select * from numbered where n <= 199 and bytes <= 524288),
told as (select qid, any_value(total) as total, max(n) as last, list(id order by n) as nodes, list(chain order by n) filter (len(chain) > 1) as chains, list(chain order by n) as routes from shown group by 1)
select b.qid, case when state = 'needs-choice' and scored or state = 'no-match' and scored then 'NOT_SURE' else op end as operation,
  case when state = 'bound' and op = 'PATH' and told.qid is null then 'no-path' when state = 'bound' then 'matched' else state end as status, case when state = 'bound' and not (op = 'PATH' and told.qid is null) then ids[1] end as seed,
  case when state <> 'bound' then '' when op = 'PATH' and told.qid is null then array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') when op = 'PATH' then array_to_string(routes[1], ',') else array_to_string(list_concat([ids[1]], coalesce(nodes, [])), ',') end as selected,
  coalesce(md5(array_to_string(list_transform(chains, lambda c: array_to_string(case when op in ('DOWNSTREAM', 'CALLERS') then list_reverse(c) else c end, '>')), ';')), '') as witnesses,
  array_to_string(offers[1:20], ',') as alternatives, case when state = 'needs-choice' and len(offers) > 20 then 'offset:20' when state = 'bound' and last < total then 'offset:' || last end as continuation
from fit b left join told using (qid)"""


@query("answer_packets", ANSWERS, ("code_files", "seeds", "path_edges", "group_edges", "code_symbols", "call_edges"), recursive=True)
def answer_packets(spark, sf_dir):
    """Questions of every kind answered in one dataflow: operation, status, nodes, witnesses, alternatives and where to go on."""
    out = packets_of(spark, sf_dir)
    chains = F.transform("witnesses", lambda w: F.array_join(w, ">"))
    return out.select(
        F.col("request_id").alias("qid"), "operation", "status", "seed", F.array_join("selected", ",").alias("selected"), F.when(F.size(chains) > 0, F.md5(F.array_join(chains, ";"))).otherwise("").alias("witnesses"),
        F.array_join("alternatives", ",").alias("alternatives"), "continuation",
    )


@query("node_witnesses", PACKETS + " select 'r' || qid as request_id, unnest(ids) as id, array_to_string(unnest(ws), '>') as witness from p", ("seeds", "path_edges"), recursive=True)
def node_witnesses(spark, sf_dir):
    """Of each node that a packet selects the chain that shows why."""
    return packets.node_witnesses(dependents_packets(spark, sf_dir)).select("request_id", "id", F.array_join("witness", ">").alias("witness"))
