"""Queries of the scorer: a batch of texts against all files and groups, from the request to the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, scoring
from archlens.plans.base import query
from archlens.plans.graphs import incoming_prior
from archlens.plans.text import NORMAL, TOKENS, MORPH, duck_list, ordered_distinct
from archlens.sources.tables import code_files, seeds

#: Texts about each question's file and group: exact, short, misspelt, missing, by responsibility, by alias and by synonym.
TEXTS = (
    "{path}", "{stem}.py", "{stem}", "{first} {second}", "where is the {stem} file", "{typo}", "{typo}.py", "no such thing at all", "{top}/missing.py", "the {top} folder", "brand {number}", "hub {number} layer",
    "auth desk", "file {top}", "{top}", "authentication desk code", "desk {number}", "the big hub", "db {number}", "{folder}", "{last}", "{last} folder", "{first}", "{second}_{first}", "brand {number} {first}", "message {first}",
)
LEARNED = (("the big hub", 11), ("the big hub", 12), ("desk 13", 14), ("message blue", 15))
FIELDS = ("path", "stem", "first", "second", "typo", "top", "number", "folder", "last")

_tok = TOKENS.format
_norm = lambda x: f"array_to_string(list_transform({_tok(x)}, lambda t: {MORPH.format('t')}), ' ')"
_terms = lambda x: ordered_distinct(f"list_transform(list_filter({_tok(x)}, lambda t: t not in {duck_list(T.STOPPED)}), lambda t: {MORPH.format('t')})").replace("lambda x, i", "lambda y, i").replace(", x) = i", ", y) = i")
_strip = lambda x: f"regexp_replace({x}, '^(?:where is|find|locate)\\s+(?:the\\s+)?', '')"
_name = lambda x: f"trim(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[.!?\\s]+$', ''), '[`\"'']', '', 'g'), '{T.FRAME}', ''), '{T.LEFT_OVER}', ''), '{T.NAMED}', ''), '\\s+'), lambda w: w not in {duck_list([*T.KIND_WORDS, *T.FILLER])}), ' '))"
_hint = lambda x: f"(select case when w in ('folder', 'directory', 'dir', 'package') then 'layer' when w in ('file', 'module', 'script') then 'file' when w is not null then 'symbol' end from (select list_filter({_tok(x)}, lambda t: t in {duck_list(T.KIND_WORDS)})[1] as w))"
_kind = lambda x: f"case when {x} in ('folder', 'directory', 'dir', 'package') then 'layer' when {x} in ('file', 'module', 'script') then 'file' when {x} is not null then 'symbol' end"

NODES_SQL = """nodes as materialized (select row_number() over (order by top) as idx, top as id, 'layer' as kind, 'Brand ' || substr(top, 6) as label, '' as path,
      ['hub ' || substr(top, 6), 'database ' || substr(top, 6), case when cast(substr(top, 6) as int) % 5 = 0 then 'auth desk' else 'desk ' || substr(top, 6) end] as aliases,
      coalesce(string_agg(distinct split_part(stem, '_', 1), ' ' order by split_part(stem, '_', 1)) filter (lines > 40), '') as descr from code_files group by top
    union all select 500 + row_number() over (order by folder), 'folder-' || left(sha256(folder), 16), 'layer', folder, '', [], '' from (select distinct folder from code_files)
    union all select 100000 + fid, path, 'file', stem || '.py', path, [], '' from code_files)"""
_texts = ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS)
_filled = "t"
for _f in FIELDS:
    _filled = f"replace({_filled}, '{{{_f}}}', {_f})"
WANTED_SQL = f"""texts as materialized (select qid * 100 + k as qid, {_filled} as text from (select qid, f.path, stem, split_part(stem, '_', 1) as first, split_part(stem, '_', 2) as second, left(stem, 2) || 'z' || substr(stem, 3) as typo, top, substr(top, 6) as number, folder, split_part(folder, '/', 2) as last
      from seeds s join code_files f on s.path = f.path), (select unnest([{_texts}]) as t, unnest(range(0, {len(TEXTS)})) as k))"""
LEARNED_SQL = "learned(alias, node) as (values " + ", ".join(f"('{a}', 'brand{n}')" for a, n in LEARNED) + ")"

#: The scorer for DuckDB, every text with every node.
def scorer_sql(wanted: str, variants: bool = False) -> str:
    """The scorer; of variants by synonyms any bare name counts before all else."""
    collide = "true" if variants else "count(distinct kind) > 1 or (bool_or(kind = 'layer') and any_value(coalesce(hint, '')) = 'layer')"
    first = "and r.qid not in (select qid from bare)" if variants else ""
    return f"""with {NODES_SQL}, {wanted}, {LEARNED_SQL},
ix as materialized (select *, lower(path) as literal, split_part(lower(path), '/', -1) as basename, regexp_replace(split_part(lower(path), '/', -1), '\\.[^.]+$', '') as own,
    {_tok("regexp_replace(split_part(path, '/', -1), '\\.[^.]+$', '')")} as own_tokens, {_norm('label')} as n_label, list_transform(aliases, lambda a: {_norm('a')}) as n_aliases, {_norm('id')} as n_id, {_norm('path')} as n_path,
    {_terms('label')} as t_label, {_terms("array_to_string(aliases, ' ')")} as t_alias, {_terms('descr')} as t_descr, {_terms('path')} as t_path, {_tok('id')} as t_id,
    case kind when 'file' then regexp_replace(split_part(lower(path), '/', -1), '\\.[^.]+$', '') else lower(split_part(label, '/', -1)) end as bare from nodes),
a as (select qid, text, {_name('text')} as name, {_tok('text')} as words, list_filter(regexp_extract_all(text, '[^\\s`"''?!,;()]+'), lambda x: contains(x, '.') and regexp_matches(x, '^[\\w./@\\[\\]-]+$')) as literals from texts),
b as (select *, {_kind(f"list_filter(words, lambda t: t in {duck_list(T.KIND_WORDS)})[1]")} as hint, case when len(literals) = 1 then literals[1] else name end as q from a),
c as (select *, regexp_matches(q, '^[\\w./@\\[\\]-]+$') as plain, {_norm('q')} as nq, {_norm(_strip('text'))} as nt from b),
d as (select *, coalesce(hint, '') = 'file' or regexp_matches(text, '\\bfilename\\b') or len(literals) > 0 or (plain and regexp_matches(q, '[/.]')) as explicit,
    q in (select basename from ix where kind = 'file') or q in (select own from ix where kind = 'file') as known,
    nq in (select unnest(list_append(list_append(n_aliases, n_id), n_label)) from ix where kind = 'layer') as named,
    nt in (select unnest(n_aliases) from ix where kind = 'layer') as said, coalesce(hint, '') = 'layer' and q in (select bare from ix where kind = 'layer') as last from c),
e as (select *, named or said or last as layer, plain and (regexp_matches(q, '_|[a-z][A-Z]') or (contains(q, '-') and not (named or said or last))) as shaped from d),
near as (select distinct qid from e, ix where kind = 'file' and not explicit and not known and not shaped and not layer and plain and length(q) >= 5 and abs(length(q) - length(own)) <= 2
    and levenshtein(lower(q), own) between 1 and case when length(q) < 8 then 1 else 2 end and levenshtein(lower(q), own) / greatest(length(q), length(own)) <= 0.2),
r as materialized (select qid, text, name, hint, words, nt, named, explicit, case when explicit or (known and not layer) or shaped or qid in (select qid from near) then q end as query from e),
f as (select qid, query, split_part(query, '/', -1) as base, contains(query, '/') as pathed from r where query is not null),
g as (select *, regexp_replace(base, '\\.[^.]+$', '') as stem, case when contains(base, '.') then '.' || split_part(base, '.', -1) else '' end as ext from f),
h as (select *, {_tok('stem')} as qt from g),
t0 as (select h.qid, idx, id, query, base, pathed, ext, case when pathed and literal = query then 'path' when not pathed and basename = query then 'basename' when ext = '' and case when pathed then regexp_replace(literal, '\\.[^.]+$', '') else own end = query then 'stem'
    when not pathed and (ext = '' or ends_with(basename, ext)) and length(stem) >= 4 and ((len(qt) > 0 and len(list_filter(qt, lambda t: not list_contains(own_tokens, t))) = 0) or contains(own, lower(stem))) then 'partial' end as tier,
    case when pathed then literal when ext <> '' then basename else own end as against from h, ix where kind = 'file'),
t1 as (select *, case when tier is null and length(query) >= 5 and abs(length(query) - length(against)) <= 2 then levenshtein(lower(query), against) end as dist from t0),
tiers as materialized (select qid, idx, id, coalesce(tier, 'fuzzy') as tier, case tier when 'path' then 60.0 when 'basename' then 50.0 when 'stem' then 40.0 when 'partial' then 30.0 else 20.0 - dist end as score, query, base, pathed, ext from t1
    where tier is not null or (dist > 0 and dist <= case when length(query) < 8 then 1 else 2 end and dist / greatest(length(query), length(against)) <= 0.2)),
strict as (select qid, (ext <> '' or pathed) and not exists (select 1 from tiers t where t.qid = g.qid and (t.tier in ('path', 'basename') or (t.ext = '' and t.tier = 'stem'))) as missing from g),
folder as (select r.qid, idx, id from r join ix on kind = 'layer' and lower(label) = name where contains(name, '/') and name not in (select literal from ix)),
real as (select qid from r where query is not null and exists (select 1 from ix where kind = 'file' and case when contains(query, '/') then literal = query else basename = query end)),
bare0 as (select r.qid, idx, id, kind, coalesce(kind = hint, false) as likes, coalesce(kind = hint, false) and kind = 'layer' and lower(label) = name as whole from r join ix on bare = name and bare <> '' where regexp_matches(name, '^\\.?[\\w-]+$')),
bare as materialized (select qid, idx, id, kind from bare0 window w as (partition by qid) qualify case when bool_or(whole) over w then whole when bool_or(likes) over w then likes else true end),
alias as (select distinct r.qid, idx, ix.id from r join learned on alias = name join ix on ix.id = node where r.qid not in (select qid from folder) and r.qid not in (select qid from real) {first}),
named_ as (select qid from bare join r using (qid) where qid not in (select qid from folder) and qid not in (select qid from alias) group by qid having {collide}),
filed as (select qid from r where query is not null and qid not in (select qid from folder) and qid not in (select qid from alias) and qid not in (select qid from named_)
    and not (qid not in (select qid from tiers) and not regexp_matches(query, '[/.]') and named)),
arch0 as (select r.qid, r.name, r.hint, r.text, {_terms('r.text')} as q, {_norm('r.text')} as raw, r.nt as original, array_to_string({_tok('r.name')}, ' ') as lq from r),
arch1 as (select *, array_to_string(q, ' ') as phrase, exists (select 1 from ix where kind = 'layer' and lower(label) = name) as full_layer from arch0),
prior as (select dst_top as p_id, count(*) as n from path_edges where type <> 'realtime' and src_top <> dst_top group by 1),
arch2 as (select qid, idx, id, q, raw, original, phrase, lq, label, aliases, t_label, t_alias, t_descr, t_path, t_id,
    case when coalesce(hint, '') = 'layer' and not full_layer and lower(split_part(label, '/', -1)) = name then 12.0 when n_label <> '' and n_label in (raw, phrase, original) then 8.0 else 4.0 * coalesce(len(list_filter(q, lambda t: list_contains(t_label, t))) / nullif(len(q), 0), 0) end as label_,
    case when len(list_filter(n_aliases, lambda x: x <> '' and x in (raw, phrase, original))) > 0 then 9.0 else 4.5 * coalesce(len(list_filter(q, lambda t: list_contains(t_alias, t))) / nullif(len(q), 0), 0) end as alias_,
    1.5 * coalesce(len(list_filter(q, lambda t: list_contains(t_descr, t))) / nullif(len(q), 0), 0) as descr_,
    case when n_path <> '' and contains(' ' || raw || ' ', ' ' || n_path || ' ') then 14.0 else 3.0 * coalesce(len(list_filter(q, lambda t: list_contains(t_path, t))) / nullif(len(q), 0), 0) end as path_,
    case when n_id in (raw, phrase, original) or (path <> '' and contains(' ' || raw || ' ', ' ' || n_id || ' ')) then 11.0 else 0.0 end as identity_,
    coalesce(len(list_filter(q, lambda t: list_contains(t_label, t) or list_contains(t_alias, t) or list_contains(t_descr, t) or list_contains(t_path, t) or list_contains(t_id, t))) / nullif(len(q), 0), 0) as coverage,
    case when n is null then 0 else least(0.08, ln(1 + n) * 0.015) end as prior from arch1, ix left join prior on p_id = id where kind = 'layer'),
arch as materialized (select *, label_ + alias_ + descr_ + path_ + identity_ as evidence, label_ + alias_ + descr_ + path_ + identity_ + prior as score,
    array_to_string({_tok('label')}, ' ') = lq or len(list_filter(aliases, lambda x: array_to_string({_tok('x')}, ' ') = lq)) > 0 or array_to_string({_tok('id')}, ' ') = lq as exact from arch2 where label_ + alias_ + descr_ + path_ + identity_ > 0),
scored as (select qid, idx, id, 60.0 as score, 60.0 as evidence, 1.0 as coverage, 'lexical' as tier, true as exact, 'architecture' as mode, false as missing, 'folder path' as branch from folder
    union all select qid, idx, id, 30, 30, 1, 'lexical', true, 'architecture', false, 'learned alias' from alias
    union all select qid, idx, id, 40, 40, 1, 'lexical', true, 'architecture', false, 'bare name' from bare where qid in (select qid from named_)
    union all select qid, idx, id, score, score, 1, tier, tier in ('path', 'basename'), 'filename', missing, 'file' from tiers join strict using (qid) where qid in (select qid from filed)
    union all select qid, null, null, 0, 0, 0, 'none', false, 'filename', missing, 'file' from filed join strict using (qid) where qid not in (select qid from tiers)
    union all select qid, idx, id, score, evidence, coverage, 'lexical', exact, 'architecture', false, 'responsibility' from arch
      where qid not in (select qid from folder) and qid not in (select qid from alias) and qid not in (select qid from named_) and qid not in (select qid from filed)),
"""


SCORER = scorer_sql(WANTED_SQL)


def finish_sql(source: str, name: str) -> str:
    """Best row, margin, label and suggestions of scored rows."""
    return f"""{name}0 as (select *, row_number() over w as rank, score - coalesce(lead(score) over w, 0) as margin, evidence > 0 and coverage >= 0.6 as present from {source} window w as (partition by qid order by score desc, idx nulls last)),
{name}1 as (select *, present and score = max(score) over (partition by qid) as tied from {name}0),
{name}2 as (select *, count_if(present) over (partition by qid) as n_present, count_if(tied) over (partition by qid) as n_tied, row_number() over (partition by qid, present order by score desc, idx) as place,
    max(case when rank = 1 then evidence >= 4 and coverage >= 0.6 and margin >= 1 and not missing and tier <> 'fuzzy' end) over (partition by qid) as yes, max(case when rank = 1 then exact end) over (partition by qid) as top_exact from {name}1),
{name} as (select *, case when yes and top_exact then 'Exact match' when yes then 'Likely match' when n_present > 0 then 'Needs your choice' else 'No match' end as label,
    present and case when mode = 'filename' or n_tied > 1 then tied or place <= greatest(3, n_tied) else place <= 3 end as suggested from {name}2)"""


HEADS = """select t.qid, coalesce(any_value(f.label), 'No match') as label, coalesce(any_value(f.yes), false) as yes, any_value(case when rank = 1 and score > 0 then f.id end) as choice, coalesce(any_value(branch), 'responsibility') as branch,
    round(coalesce(max(case when rank = 1 then margin end), 0), 6) as margin, coalesce(array_to_string(list(f.id order by score desc, idx) filter (suggested), ','), '') as suggestions, count(*) filter (suggested) as n_suggestions from texts t left join {} f using (qid) group by t.qid"""
VIEWS = ("code_files", "seeds", "path_edges")


def nodes(spark, sf_dir):
    """(idx, id, kind, label, path, aliases, descr): groups, folders and files."""
    files = code_files(spark, sf_dir)
    number = F.substring("top", F.lit(6), F.lit(9))
    first = F.substring_index("stem", "_", 1)
    tops = files.groupBy("top").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("lines") > 40, first))), " ").alias("descr"))
    row = lambda c: F.row_number().over(graph_order(c))
    desk = F.when(number.cast("int") % 5 == 0, F.lit("auth desk")).otherwise(F.concat(F.lit("desk "), number))
    layers = tops.select(row("top").cast("long").alias("idx"), F.col("top").alias("id"), F.lit("layer").alias("kind"), F.concat(F.lit("Brand "), number).alias("label"), F.lit("").alias("path"), F.array(F.concat(F.lit("hub "), number), F.concat(F.lit("database "), number), desk).alias("aliases"), "descr")
    none = F.array().cast("array<string>").alias("aliases")
    folders = files.select("folder").distinct().select((500 + row("folder")).cast("long").alias("idx"), F.concat(F.lit("folder-"), F.substring(F.sha2("folder", 256), 1, 16)).alias("id"), F.lit("layer").alias("kind"), F.col("folder").alias("label"), F.lit("").alias("path"), none, F.lit("").alias("descr"))
    own = files.select((100000 + F.col("fid")).alias("idx"), F.col("path").alias("id"), F.lit("file").alias("kind"), F.concat("stem", F.lit(".py")).alias("label"), "path", none, F.lit("").alias("descr"))
    return layers.unionByName(folders).unionByName(own)


def graph_order(c):
    from pyspark.sql import Window

    return Window.orderBy(c)


def texts(spark, sf_dir):
    """(qid, text): every template for the first file of each group."""
    s = seeds(spark, sf_dir)
    rows = s.join(code_files(spark, sf_dir), "path")
    part = lambda c, i: F.coalesce(F.get(F.split(c, "/" if c == "folder" else "_"), F.lit(i)), F.lit(""))
    typo = F.concat(F.substring("stem", 1, 2), F.lit("z"), F.substring("stem", F.lit(3), F.lit(999)))
    rows = rows.select("qid", "path", "stem", part("stem", 0).alias("first"), part("stem", 1).alias("second"), typo.alias("typo"), "top", F.substring("top", F.lit(6), F.lit(9)).alias("number"), "folder", part("folder", 1).alias("last"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, TEXTS))).alias("k", "t"))
    filled = F.col("t")
    for f in FIELDS:
        filled = F.replace(filled, F.lit("{" + f + "}"), F.col(f))
    return rows.select((F.col("qid") * 100 + F.col("k")).alias("qid"), filled.alias("text"))


def learned(spark):
    return spark.createDataFrame([(a, f"brand{n}") for a, n in LEARNED], "alias string, node string")


def prior(spark, sf_dir):
    """How much each group is used by others, as a small weight."""
    from archlens.sources.tables import path_edges

    n = path_edges(spark, sf_dir).where("type <> 'realtime' and src_top <> dst_top").groupBy(F.col("dst_top").alias("id")).agg(F.count("*").alias("n"))
    return n.select("id", F.least(F.lit(0.08), F.log1p("n") * 0.015).alias("prior"))


def prepared(spark, sf_dir):
    return graph.cut(texts(spark, sf_dir)), graph.wide(graph.cut(scoring.indexed(nodes(spark, sf_dir))))


@query("file_requests", SCORER + "z as (select 1) select qid, query, explicit from r where query is not null", VIEWS)
def file_requests(spark, sf_dir):
    """Texts that ask for a file, and for which: a literal name, a kind word, a known or file-like name, a near miss of one."""
    t, index = prepared(spark, sf_dir)
    return scoring.requested(t, index).where("query is not null").select("qid", "query", "explicit")


@query("filename_tiers", SCORER + "z as (select 1) select qid, id, tier, cast(score as double) as score from tiers", VIEWS)
def filename_tiers(spark, sf_dir):
    """Path, basename, stem, part of a name or a misspelling: the best tier of each file for each request."""
    t, index = prepared(spark, sf_dir)
    return scoring.file_scores(graph.cut(scoring.requested(t, index)), index).select("qid", "id", "tier", "score")


@query("missing_exact", SCORER + "z as (select 1) select qid, missing from strict", VIEWS)
def missing_exact(spark, sf_dir):
    """Requests that name an extension or folder of a file that is not there."""
    t, index = prepared(spark, sf_dir)
    asked = graph.cut(scoring.requested(t, index)).where("query is not null")
    return scoring.missing_exact(asked, scoring.file_scores(asked, index))


@query("bare_names", SCORER + "z as (select 1) select qid, id, kind from bare", VIEWS)
def bare_names(spark, sf_dir):
    """Nodes whose bare name a text is, of the kind it hints at if there are any."""
    t, index = prepared(spark, sf_dir)
    asked = t.select("qid", T.filename_text(F.col("text")).alias("name"), T.kind_hint(F.col("text")).alias("hint"))
    return scoring.bare_candidates(asked, index).select("qid", "id", "kind")


@query("architecture_scores", SCORER + "z as (select 1) select qid, id, round(label_, 6) as label_, round(alias_, 6) as alias_, round(descr_, 6) as descr_, round(path_, 6) as path_, round(identity_, 6) as identity_, round(prior, 6) as structural, round(score, 6) as score, round(coverage, 6) as coverage, exact from arch", VIEWS)
def architecture_scores(spark, sf_dir):
    """Groups by label, aliases, description, path, identity and use, each with its part of the score."""
    t, index = prepared(spark, sf_dir)
    asked = t.select("qid", "text", T.filename_text(F.col("text")).alias("name"), T.kind_hint(F.col("text")).alias("hint"))
    rows = scoring.architecture_scores(asked, index, prior(spark, sf_dir))
    parts = ("label_", "alias_", "descr_", "path_", "identity_", "structural", "score", "coverage")
    return rows.select("qid", "id", *[F.round(c, 6).alias(c) for c in parts], "exact")


def shown(heads):
    return heads.select("qid", "label", "yes", "choice", "branch", F.round("margin", 6).alias("margin"), F.array_join("suggestions", ",").alias("suggestions"), F.size("suggestions").cast("long").alias("n_suggestions"))


@query("target_precedence", SCORER + finish_sql("scored", "fin") + " " + HEADS.format("fin"), VIEWS)
def target_precedence(spark, sf_dir):
    """What each text means literally, by the first branch it belongs to, and the decision: exact, likely, a choice with all that tie, or nothing."""
    t, index = prepared(spark, sf_dir)
    ranked = scoring.finished(scoring.rank_literal(t, index, learned(spark), prior(spark, sf_dir)))
    return shown(scoring.heads(t, graph.cut(ranked)))


@query("decision", SCORER + finish_sql("scored", "fin") + " select qid, id, rank, label, round(exp((score - max(score) over (partition by qid)) / 1.5), 6) as weight, suggested from fin where rank <= 3 and score > 0", VIEWS)
def decision(spark, sf_dir):
    """The three best of each text with their weight before normalisation, and whether they are proposed."""
    from pyspark.sql import Window

    t, index = prepared(spark, sf_dir)
    ranked = scoring.finished(scoring.rank_literal(t, index, learned(spark), prior(spark, sf_dir)))
    w = F.exp((F.col("score") - F.max("score").over(Window.partitionBy("qid"))) / 1.5)
    return ranked.withColumn("weight", F.round(w, 6)).where("rank <= 3 and score > 0").select("qid", "id", F.col("rank").cast("long").alias("rank"), "label", "weight", "suggested")


#: Texts that literally mean nothing, tried with synonyms.
HOPELESS = ("db {number}", "config {first} env", "msg {number} repo")
_pairs = ", ".join(f"('{w}', '{x}', {10 * i + j})" for i, g in enumerate(T.SYNONYMS) for w in g for j, x in enumerate(g) if x != w)
_hopeless = WANTED_SQL.replace(_texts, ", ".join(f"'{t}'" for t in HOPELESS)).replace(f"range(0, {len(TEXTS)})", f"range(0, {len(HOPELESS)})").replace("texts as materialized", "base as materialized")
VARIANTS_SQL = _hopeless + f""", syn(word, into_, ord) as (values {_pairs}), cut as (select qid, text, unnest(string_split(text, ' ')) as word, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos from base),
made as (select qid, row_number() over (partition by qid order by pos, ord) as n, array_to_string(list_transform(string_split(text, ' '), lambda w, i: case when i = pos then into_ else w end), ' ') as text from cut join syn using (word)),
texts as materialized (select qid * 100 + n as qid, text from made where n <= 16)"""


def hopeless(spark, sf_dir):
    rows = texts(spark, sf_dir).where(F.col("qid") % 100 == 0).select((F.col("qid") / 100).cast("long").alias("qid"))
    s = seeds(spark, sf_dir).join(rows, "qid").join(code_files(spark, sf_dir), "path").select("qid", F.split("stem", "_")[0].alias("first"), F.substring("top", F.lit(6), F.lit(9)).alias("number"))
    made = s.select("*", F.posexplode(F.array(*map(F.lit, HOPELESS))).alias("k", "t"))
    return made.select((F.col("qid") * 100 + F.col("k")).alias("qid"), F.replace(F.replace("t", F.lit("{number}"), F.col("number")), F.lit("{first}"), F.col("first")).alias("text"))


@query("synonym_variants", f"with {VARIANTS_SQL} select qid // 100 as qid, qid % 100 as n, text from texts", VIEWS)
def synonym_variants(spark, sf_dir):
    """Each text with one word at a time replaced by its synonyms, sixteen at most."""
    rows = hopeless(spark, sf_dir).select("qid", F.posexplode(T.synonym_variants(F.col("text"))).alias("n", "v"))
    return rows.select("qid", (F.col("n") + 1).cast("long").alias("n"), "v.text")


@query(
    "synonym_rank",
    scorer_sql(VARIANTS_SQL, variants=True) + finish_sql("scored", "fin") + " select qid // 100 as qid, id, round(max(score) * 0.75, 6) as score from fin where suggested group by 1, 2",
    VIEWS,
)
def synonym_rank(spark, sf_dir):
    """Nodes that a text means by a synonym, at three quarters of the score; of several ways to a node the best."""
    t, index = graph.cut(hopeless(spark, sf_dir)), graph.wide(graph.cut(scoring.indexed(nodes(spark, sf_dir))))
    ranked = scoring.rank(t, index, learned(spark), prior(spark, sf_dir))
    return ranked.where("branch = 'synonym'").select("qid", "id", F.round("score", 6).alias("score"))


#: Questions whose ends may be files, groups or definitions.
CROSS = ("What calls {first}?", "callers of {path}", "how does {first} reach {stem}", "where is {last}", "what depends on {last}?", "what depends on the {top} folder?", "trace from function {first}", "upstream of {path}", "callees of {stem}", "who calls {qual}", "how does {path} reach {qual}", "what uses {stem}", "path to {stem}", "{qual}")
_cross = ", ".join("'" + t.replace("'", "''") + "'" for t in CROSS)
_said = "t"
for _f, _v in (("path", "path"), ("stem", "stem"), ("first", "split_part(stem, '_', 1)"), ("top", "top"), ("last", "split_part(folder, '/', 2)"), ("qual", "path || ':' || regexp_replace(stem, '_[0-9]+$', '')")):
    _said = f"replace({_said}, '{{{_f}}}', {_v})"
_pick = lambda rules, column: "case " + " ".join(f"when {w} then {v}" for w, v in rules) + f" else null end as {column}"
_rule = [(f"regexp_matches(normal, '{p}')", op, p, a, b) for op, p, a, b in T.SYMBOL_RULES]
_ends = [(f"regexp_matches(normal, '{p}')" + (f" and not (regexp_matches(normal, '{T.HANDLERS}') and not regexp_matches(normal, '{T.ENDS_MISSING}'))" if op == "MALFORMED" else ""), op, p, a, b) for op, p, a, b in T.RULES]
_x = lambda p, g: "null" if g is None else f"regexp_extract(normal, '{p}', {g})"


def resolution_sql(asked: str) -> str:
    """Steps from asked, a select of (qid, question), to ``z`` with the outcome of each question; they follow NODES_SQL."""
    return f"""cross_ as ({asked}),
    sym as (select id, name, qualname, path from code_symbols), bar as (select id, kind, case kind when 'file' then regexp_replace(split_part(lower(path), '/', -1), '\\.[^.]+$', '') else lower(split_part(label, '/', -1)) end as bare, label, path from nodes),
    snames as (select distinct id, {NORMAL.format('k')} as key from (select id, unnest([id, name, qualname, path || ':' || qualname]) as k from sym)),
    n as (select qid, question, {NORMAL.format('question')} as normal from cross_),
    i as (select *, {_pick([(w, f"'{'PATH' if op == 'MALFORMED' else op}'") for w, op, *_ in _ends], 'i_op0')}, {_pick([(w, 'null' if op in ('PATH', 'MALFORMED') else _x(p, a)) for w, op, p, a, b in _ends], 'i_target0')}, {_pick([(w, _x(p, a) if op == 'PATH' else 'null') for w, op, p, a, b in _ends], 'i_from')}, {_pick([(w, _x(p, b) if op == 'PATH' else 'null') for w, op, p, a, b in _ends], 'i_to')},
      {_pick([(w, f"'{op}'") for w, op, *_ in _rule], 's_op0')}, {_pick([(w, _x(p, a)) for w, op, p, a, b in _rule], 's_first0')}, {_pick([(w, _x(p, b)) for w, op, p, a, b in _rule], 's_second')}, normal in (select key from snames) and normal not in (select id from nodes) as whole from n),
    j as (select *, coalesce(i_op0, 'LOCATE') as intent, case when i_op0 is null then normal else i_target0 end as i_target, coalesce(s_op0, case when whole then 'LOCATE' end) as s_op, case when s_op0 is null and whole then normal else s_first0 end as s_first, {_kind(f"list_filter({_tok('question')}, lambda t: t in {duck_list(T.KIND_WORDS)})[1]")} as q_hint from i),
    a as (select qid, normal, i_target, coalesce(s_op, intent) as op, intent, s_op is not null as by_symbol, q_hint, case when s_op is not null then [s_first, s_second] when intent = 'PATH' then [i_from, i_to] else [i_target] end as ends from j where not (intent = 'PATH' and i_from is null)),
    e0 as (select qid, op, q_hint, unnest(list_filter(ends, lambda z: z is not null)) as text, generate_subscripts(list_filter(ends, lambda z: z is not null), 1) - 1 as place from a),
    e as (select *, {_name('text')} as name, {_kind(f"list_filter({_tok('text')}, lambda t: t in {duck_list(T.KIND_WORDS)})[1]")} as own_hint, {NORMAL.format('text')} as key from e0),
    f as (select *, coalesce(own_hint, case when op = 'LOCATE' then q_hint end) as hint from e),
    every_ as (select id, kind, bare as name from bar union all select id, 'symbol', lower(name) from sym),
    l0 as (select f.qid, place, x.id, x.kind, hint from f join every_ x using (name) where regexp_matches(f.name, '^\\.?[\\w-]+$') and f.name <> ''),
    l1 as (select * from l0 where (qid, place) in (select (qid, place) from l0 group by qid, place having count(distinct kind) > 1)),
    l as (select qid, place, id, 0 as ord from l1 x where kind = hint or not exists (select 1 from l1 y where y.qid = x.qid and y.place = x.place and y.kind = y.hint)),
    g as (select * from l union all select qid, place, id, 1 from f join snames using (key) union all select qid, place, s.id, 2 from f join snames s on f.name = s.key where hint = 'symbol'
      union all select distinct qid, place, b.id, 3 from f join bar b on f.name <> '' and f.name in (lower(b.id), lower(b.path), case when b.kind = 'layer' then lower(label) end)),
    h as (select distinct qid, place, id, ord from g where ord = (select min(ord) from g g2 where g2.qid = g.qid and g2.place = g.place)),
    t as (select qid, place, list_sort(list(distinct id)) as ids, max(case when ord = 0 then 1 else 0 end) as collision, min(case when id in (select id from sym) then 1 else 0 end) as symbol from h group by 1, 2),
    r as (select f.qid, f.place, ids, coalesce(collision, 0) as collision, coalesce(symbol, 0) as symbol, coalesce(len(ids), 0) as n, coalesce(own_hint, '') = 'layer' and f.name in (select id from nodes) as canonical from f left join t using (qid, place)),
    p as (select qid, max(collision) as collision, min(n) as least, max(n) as most, max(symbol) as some_, min(symbol) as all_, bool_or(canonical) as canonical, arg_min(ids, case when n > 1 then place else 9 end) as choice, list(ids[1] order by place) as single from r group by 1),
    o as (select a.*, p.* exclude (qid), case op when 'CALLERS' then 'DOWNSTREAM' when 'CALLEES' then 'UPSTREAM' when 'TRACE' then 'UPSTREAM' when 'FLOW' then 'PATH' else op end as file_op from a join p using (qid)),
    z as (select *, case when collision = 0 and not (least = 1 and most = 1 and (canonical or (by_symbol and op <> 'LOCATE' and intent <> file_op) or (intent <> 'LOCATE' and some_ = 1))) then 'scored' when most > 1 then 'needs-choice' when least = 0 then 'unresolved' when some_ <> all_ then 'unsupported' when some_ = 1 then 'symbols' else 'files' end as outcome from o)"""


_cross_sql = f"select qid * 100 + k as qid, {_said} as question from (select s.qid, f.* from seeds s join code_files f using (path)), (select unnest([{_cross}]) as t, unnest(range(0, {len(CROSS)})) as k)"


@query(
    "operation_resolution",
    f"""with {NODES_SQL}, {resolution_sql(_cross_sql)}
    select qid, op, file_op, outcome, case when outcome = 'needs-choice' then array_to_string(choice[1:20], ',') when outcome in ('symbols', 'files') then array_to_string(single, ',') end as ids from z""",
    ("code_files", "seeds", "code_symbols"),
)
def operation_resolution(spark, sf_dir):
    """Which graph a question is about, by its names alone: definitions, files and groups, a choice between kinds, or left to the scorer."""
    from archlens.sources.tables import code_symbols

    files = code_files(spark, sf_dir)
    rows = seeds(spark, sf_dir).join(files, "path").withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("t")) for i, t in enumerate(CROSS)])))
    said = F.col("t.t")
    values = {"path": F.col("path"), "stem": F.col("stem"), "first": F.substring_index("stem", "_", 1), "top": F.col("top"), "last": F.substring_index("folder", "/", -1), "qual": F.concat("path", F.lit(":"), F.regexp_replace("stem", "_[0-9]+$", ""))}
    for name, value in values.items():
        said = F.replace(said, F.lit("{" + name + "}"), value)
    asked = graph.cut(rows.select((F.col("qid") * 100 + F.col("t.k")).alias("qid"), said.alias("question")))
    index = graph.wide(graph.cut(scoring.indexed(nodes(spark, sf_dir))))
    out = scoring.resolved(asked, index, graph.wide(graph.cut(code_symbols(spark, sf_dir).select("id", "name", "qualname", "path"))))
    return out.select("qid", "op", "file_op", "outcome", F.array_join(F.slice("ids", 1, 20), ",").alias("ids"))
