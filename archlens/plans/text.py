"""Queries of the text plane: tokens, questions, grammar, edit distance, concept search."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, ranking, text_index
from archlens.plans.base import greedy_sql, query
from archlens.sources.tables import code_files, table

#: Phrases of questions: each file is asked about by one of them, chosen by its number.
PHRASES = ["Where is {}?", "What's the file {}", "What depends on {}?", "who uses {}.", "What does {} import?", "dependencies of {}", "How does {} reach app.py?", "show a path from {} to app.py", "What would break if {} changed?", "Which module is called {}!", "path to {}", "find \"{}\", please"]
QUESTIONS = "questions as (select fid as qid, replace(case fid % 12 " + " ".join("when {} then '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES)) + " end, '{}', case when fid % 5 = 0 then stem else path end) as question from code_files)"

NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), '’', ''''), '\b(where|what|who|how)''?s\b', '\1 is', 'g'), '[.!?\s]+$', ''), '[`"''?!,;()]', ' ', 'g'), '\s+', ' ', 'g'))"""
TOKENS = r"regexp_extract_all(lower(regexp_replace(coalesce({}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
MORPH = "case when {0} in ('authentication', 'authenticated', 'authenticating') then 'auth' when {0} in ('grading', 'grader', 'graded') then 'grade' else {0} end"


def duck_list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def ordered_distinct(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


TERMS_RAW = "list_transform(list_filter(" + TOKENS + ", lambda t: t not in " + duck_list(T.STOPPED) + "), lambda t: " + MORPH.format("t") + ")"
CONCEPT = "list_transform(list_filter(list_distinct(" + TERMS_RAW + "), lambda t: t not in " + duck_list(T.QUESTION_STOP) + "), lambda t: case when length(t) > 4 and ends_with(t, 's') and not ends_with(t, 'ss') then left(t, -1) else t end)"


def questions(spark, sf_dir):
    files = code_files(spark, sf_dir)
    phrase = F.lit(None).cast("string")
    for i, p in enumerate(PHRASES):
        phrase = F.when(F.col("fid") % 12 == i, F.lit(p)).otherwise(phrase)
    name = F.when(F.col("fid") % 5 == 0, F.col("stem")).otherwise(F.col("path"))
    return files.select(F.col("fid").alias("qid"), F.replace(phrase, F.lit("{}"), name).alias("question"))


@query("tokens_scorer", f"select doc_id as id, array_to_string({TOKENS.format('text')}, ' ') as tokens from documents")
def tokens_scorer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


SPLIT = r"regexp_replace(regexp_replace(regexp_replace(x, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([0-9])', '\1 \2', 'g')"


@query(
    "tokens_builder",
    f"""with c as (select doc_id as id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as x, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+'), 1) as i from documents),
    w as (select id, i, string_split({SPLIT}, ' ') as ws, x from c), t as (select id, i, unnest(case when len(ws) > 1 then list_append(ws, x) else ws end) as t, generate_subscripts(case when len(ws) > 1 then list_append(ws, x) else ws end, 1) as j from w),
    f as (select id, lower(t) as t, min((i, j)) as at_ from t where length(t) > 1 group by 1, 2)
    select d.doc_id as id, coalesce(string_agg(t, ' ' order by at_), '') as tokens from documents d left join f on d.doc_id = f.id group by 1""",
)
def tokens_builder(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.builder_tokens(F.col("text")), " ").alias("tokens"))


@query("content_terms", f"select doc_id as id, array_to_string(list_sort(list_distinct({TERMS_RAW.format('text')})), ' ') as terms from documents")
def content_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


@query("normalize_question", f"with {QUESTIONS} select qid, {NORMAL.format('question')} as normal from questions", ("code_files",))
def normalize_question(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", T.normalize_question(F.col("question")).alias("normal"))


def duck_intent():
    out, fields = [], {"op": [], "target": [], "from_": [], "to_": []}
    for op, pattern, a, b in T.RULES:
        p = pattern.replace("'", "''")
        fits = f"regexp_matches(normal, '{p}')"
        if op == "MALFORMED":
            fits += f" and not (regexp_matches(normal, '{T.HANDLERS}') and not regexp_matches(normal, '{T.ENDS_MISSING}'))"
        got = lambda g, p=p: "null" if g is None else f"regexp_extract(normal, '{p}', {g})"
        fields["op"].append((fits, f"'{'PATH' if op == 'MALFORMED' else op}'"))
        fields["target"].append((fits, "null" if op in ("PATH", "MALFORMED") else got(a)))
        fields["from_"].append((fits, got(a) if op == "PATH" else "null"))
        fields["to_"].append((fits, got(b) if op == "PATH" else "null"))
    for name, cases in fields.items():
        last = {"op": "'LOCATE'", "target": "normal"}.get(name, "null")
        out.append("case " + " ".join(f"when {w} then {t}" for w, t in cases) + f" else {last} end as {name}")
    return ", ".join(out)


@query("intent_parse", f"with {QUESTIONS}, n as (select qid, {NORMAL.format('question')} as normal from questions) select qid, {duck_intent()} from n", ("code_files",))
def intent_parse(spark, sf_dir):
    rows = questions(spark, sf_dir).select("qid", T.normalize_question(F.col("question")).alias("normal"))
    return rows.select("qid", T.intent(F.col("normal")).alias("i")).select("qid", "i.op", "i.target", F.col("i.from").alias("from_"), F.col("i.to").alias("to_"))


@query("symbol_requests", f"""with {QUESTIONS}, n as (select qid, {NORMAL.format('question')} as normal from questions)
  select qid, case when regexp_matches(normal, '^where is (.+?) defined$') then 'LOCATE' when regexp_matches(normal, '^how does (.+?) reach (.+)$') then 'FLOW' end as op from n
  where regexp_matches(normal, '^where is (.+?) defined$|^(locate|find) (function|class|method|symbol) (.+)$|^(what calls|who invokes|who calls|callers of) (.+)$|^where is (.+?) called from$|^what does (.+) call$|^callees of (.+)$|^how does (.+?) reach (.+)$|^trace from (.+)$')""", ("code_files",))
def symbol_requests(spark, sf_dir):
    rows = questions(spark, sf_dir).select("qid", T.symbol_request(T.normalize_question(F.col("question"))).alias("s"))
    return rows.where("s is not null").select("qid", "s.op")


@query("kind_hints", f"with {QUESTIONS}, t as (select qid, list_filter({TOKENS.format('question')}, lambda t: t in {duck_list(T.KIND_WORDS)})[1] as word from questions) select qid, case when word in ('folder', 'directory', 'dir', 'package') then 'layer' when word in ('file', 'module', 'script') then 'file' when word is not null then 'symbol' end as kind from t", ("code_files",))
def kind_hints(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", T.kind_hint(F.col("question")).alias("kind"))


@query("filename_text", rf"""with {QUESTIONS}, n as (select qid, {NORMAL.format('question')} as normal from questions),
  f as (select qid, regexp_replace(regexp_replace(regexp_replace(normal, '^(please\s+)?((where|what|who|how)\s+(is|are|does)|find|locate|show(\s+me)?)\s+(the\s+)?', ''), '\s+(live|lives|located)$', ''), '^(file(name)?|named)\s+', '') as t from n)
  select qid, trim(array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x not in {duck_list([*T.KIND_WORDS, *T.FILLER])}), ' ')) as name from f""", ("code_files",))
def filename_text(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", T.filename_text(T.normalize_question(F.col("question"))).alias("name"))


NAMES = "names as (select distinct lower(split_part(p_name, ' ', 1)) as name from part union select distinct lower(split_part(p_type, ' ', 2)) from part)"


@query("fuzzy_names", f"with {NAMES} select a.name, b.name as other, levenshtein(a.name, b.name) as d from names a join names b on a.name < b.name and abs(length(a.name) - length(b.name)) <= 2 where levenshtein(a.name, b.name) <= 2 + 1 and levenshtein(a.name, b.name) <= 2")
def fuzzy_names(spark, sf_dir):
    """Pairs of distinct words at most two edits apart."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.lower(F.substring_index("p_name", " ", 1)).alias("name")).union(part.select(F.lower(F.get(F.split("p_type", " "), F.lit(1)))))
    return ranking.close_words(names.distinct())


TEXTS = r"""texts as (select doc_id as id, left(source, 80) as name, left(source || '/' || lang, 120) as path, left(trim(regexp_replace(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\n\s*\n')[1], '[ \t\r\n]+', ' ', 'g')), 300) as docstring from documents)"""
KINDS = {"en": "file", "de": "layer"}
_kind = "case " + " ".join(f"when lang = '{a}' then '{b}'" for a, b in KINDS.items()) + " else 'symbol' end"
#: Three questions about each text, of its first words and its name; some hint at a kind.
PROBE = ("where is the {0} {1} file", "{1} {2} {name}", "the {0} {name} folder")
_word = lambda i: f"coalesce(string_split(docstring, ' ')[{i + 1}], '')"
_probe = "t"
for _i in range(3):
    _probe = f"replace({_probe}, '{{{_i}}}', {_word(_i)})"
PROBES = f"""probes as materialized (select id * 3 + k as qid, replace({_probe}, '{{name}}', coalesce(name, '')) as question from texts,
  (select unnest([{", ".join(f"'{t}'" for t in PROBE)}]) as t, unnest(range(0, {len(PROBE)})) as k))"""


def probes(spark, sf_dir, texts=None):
    """(qid, question): what is asked of the index."""
    rows = (code_text(spark, sf_dir) if texts is None else texts).select("id", "name", F.split("docstring", " ").alias("w"), F.posexplode(F.array(*map(F.lit, PROBE))).alias("k", "t"))
    said = F.col("t")
    for i in range(3):
        said = F.replace(said, F.lit("{%d}" % i), F.coalesce(F.get("w", F.lit(i)), F.lit("")))
    return rows.select((F.col("id") * 3 + F.col("k")).alias("qid"), F.replace(said, F.lit("{name}"), F.coalesce("name", F.lit(""))).alias("question"))


def code_text(spark, sf_dir):
    body = F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    first = F.trim(F.regexp_replace(F.get(F.split(body, r"\n\s*\n", 2), F.lit(0)), r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("source", 1, 80).alias("name"), F.substring(F.concat_ws("/", "source", "lang"), 1, 120).alias("path"), F.substring(first, 1, 300).alias("docstring"))


POSTINGS = f"""post as (select id, term, sum(w) as tf from (select id, unnest({CONCEPT.format('name')}) as term, 2.0::double as w from texts union all select id, unnest({CONCEPT.format('path')}), 0.5 from texts union all select id, unnest({CONCEPT.format('docstring')}), 1.5 from texts) group by 1, 2)"""


@query("search_text", f"with {TEXTS} select id, name, path, docstring from texts")
def search_text(spark, sf_dir):
    return code_text(spark, sf_dir)


@query("bm25_stats", f"with {TEXTS}, {POSTINGS} select term, count(*) as df, round(sum(tf), 6) as tf from post group by 1")
def bm25_stats(spark, sf_dir):
    return ranking.postings(code_text(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 6).alias("tf"))


@query("bm25_lengths", f"with {TEXTS}, {POSTINGS} select texts.id, round(coalesce(sum(tf), 0), 6) as length from texts left join post using (id) group by 1")
def bm25_lengths(spark, sf_dir):
    docs = code_text(spark, sf_dir)
    return ranking.lengths(ranking.postings(docs), docs).select("id", F.round("length", 6).alias("length"))


BM25 = f"""with {TEXTS}, {POSTINGS}, {PROBES},
  len as (select texts.id, coalesce(sum(tf), 0) as length from texts left join post using (id) group by 1),
  whole as (select count(*) as docs, avg(length) as mean from len),
  q as (select qid, unnest(list_distinct({CONCEPT.format(NORMAL.format('question'))})) as term, len(list_distinct({CONCEPT.format(NORMAL.format('question'))})) as n from probes),
  df as (select term, count(*) as df from post group by 1),
  gated as (select qid, term, n, df from q join df using (term) qualify count(*) over (partition by qid) = n)"""


@query(
    "bm25_search",
    BM25 + f""", kinds as (select doc_id as id, {_kind} as kind from documents),
  hints as (select qid, case when w in {tuple(k for k, v in T.KIND_WORDS.items() if v == "layer")} then 'layer' when w in {tuple(k for k, v in T.KIND_WORDS.items() if v == "file")} then 'file' when w is not null then 'symbol' end as hint
    from (select qid, list_filter({TOKENS.format('question')}, lambda t: t in {duck_list(T.KIND_WORDS)})[1] as w from probes)),
  s as (select qid, p.id, n, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score, count(*) as matched from gated join post p using (term) join len on p.id = len.id, whole group by all),
  k as (select *, row_number() over (partition by qid order by round(score, 9) desc, coalesce(kind = hint, false) desc, id) as rank from s join kinds using (id) join hints using (qid) where round(score, 9) >= 4 and matched / n >= 0.5)
  select qid, rank, id, round(score, 6) as score, matched from k where rank <= 8""",
)
def bm25_search(spark, sf_dir):
    """Three questions about each text of the table, against an index that is built once."""
    kind = F.coalesce(*[F.when(F.col("lang") == a, b) for a, b in KINDS.items()], F.lit("symbol"))
    kinds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("kind"))
    texts = graph.cut(code_text(spark, sf_dir))  # whole texts are read once
    return text_index.search(text_index.build(texts.join(kinds, "id")), probes(spark, sf_dir, texts))


@query("bm25_vocab_gate", BM25 + " select qid, question, qid in (select qid from gated) as searched from probes")
def bm25_vocab_gate(spark, sf_dir):
    """Questions all of whose terms are in the vocabulary; others are not searched."""
    asked = graph.cut(probes(spark, sf_dir))
    words = ranking.postings(code_text(spark, sf_dir)).select("term").distinct()
    q = ranking.query_terms(asked)
    missing = q.join(words, "term", "left_anti").select("qid").distinct().withColumn("out", F.lit(True))
    some = q.select("qid").distinct().withColumn("has", F.lit(True))
    return asked.join(some, "qid", "left").join(missing, "qid", "left").select("qid", "question", (F.col("has").isNotNull() & F.col("out").isNull()).alias("searched"))


@query("excerpt_range", "select doc_id, line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents) where line_no between 2 and 4")
def excerpt_range(spark, sf_dir):
    """Lines 2 to 4 of each source."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line").where("line_no between 2 and 4")


@query("excerpt_budget", "select doc_id, count(*) as lines, cast(max(used) as bigint) as bytes from (select doc_id, line_no, sum(octet_length(encode(line)) + 1) over (partition by doc_id order by line_no) as used from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)) where used <= 1000 group by 1")
def excerpt_budget(spark, sf_dir):
    """Whole lines from the start within 1,000 bytes: a running sum inside each text, no shuffle."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.octet_length(x) + 1)
    step = F.aggregate(sizes, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("bytes"), F.lit(True).alias("on")), lambda a, n: F.when(a["on"] & (a["bytes"] + n <= 1000), F.struct((a["lines"] + 1).alias("lines"), (a["bytes"] + n).alias("bytes"), F.lit(True).alias("on"))).otherwise(F.struct(a["lines"].alias("lines"), a["bytes"].alias("bytes"), F.lit(False).alias("on"))))
    return table(spark, sf_dir, "documents").select("doc_id", step.alias("s")).where("s.lines > 0").select("doc_id", F.col("s.lines").cast("long").alias("lines"), F.col("s.bytes").cast("long").alias("bytes"))


@query("search_text_budget", "with " + TEXTS + ", s as (select id, path as grp, octet_length(encode(name)) + octet_length(encode(path)) + octet_length(encode(docstring)) + 40 as size from texts), g as (" + greedy_sql("select grp, id, size from s", "grp", "id", "size", 1500) + "), k as (select grp, count(*) as kept from g group by 1) select s.grp, coalesce(any_value(kept), 0) as kept, count(*) - coalesce(any_value(kept), 0) as omitted from s left join k using (grp) group by 1")
def search_text_budget(spark, sf_dir):
    """How many records of each source and language fit a budget of bytes in input order, and how many are left out; a smaller one may fit
    after a larger one did not."""
    size = F.octet_length("name") + F.octet_length("path") + F.octet_length("docstring") + 40
    rows = code_text(spark, sf_dir).select(F.col("path").alias("grp"), "id", size.cast("long").alias("size"))
    return graph.within_budget(rows, "grp", "id", "size", 1500).groupBy("grp").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))
