"""The scorer: which node a text means, by tiers of lexical evidence, or that it cannot be told.

Texts come as a table and are ranked together. No text is compared with every node: what can score at all is found by equal joins
on paths, names, tokens, character runs and pieces of names, and only then scored; what is in no such row scores 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators.graph import cut, wide

# Scores of the branches, acceptance, and the least length of a part of a name.
FULL_PATH, ALIAS, NAME, FILE = 60.0, 30.0, 40.0, {"path": 60.0, "basename": 50.0, "stem": 40.0, "partial": 30.0, "fuzzy": 20.0}
EVIDENCE, COVERED, MARGIN, SYNONYM = 4.0, 0.6, 1.0, 0.75
PART, FUZZY_LEAST, FUZZY_SHORT, FUZZY_RATIO = 4, 5, 8, 0.2
LITERAL = r"^[\w./@\[\]-]+$"
PREFIX = r"^(?:where is|find|locate)\s+(?:the\s+)?"


def indexed(nodes: DataFrame) -> DataFrame:
    """nodes(idx, id, kind, label, path, aliases, descr) with what is compared: names, words and terms of each field."""
    low = F.lower(F.coalesce("path", F.lit("")))
    base = F.substring_index(low, "/", -1)
    n = lambda c: F.transform(c, lambda a: T.normalized(a))
    rows = nodes.withColumn("literal", low).withColumn("basename", base).withColumn("stem", F.regexp_replace(base, r"\.[^.]+$", ""))
    rows = rows.withColumn("stem_tokens", T.tokens(F.regexp_replace(F.substring_index(F.coalesce("path", F.lit("")), "/", -1), r"\.[^.]+$", "")))
    rows = rows.withColumn("n_label", T.normalized(F.col("label"))).withColumn("n_aliases", n(F.coalesce("aliases", F.array().cast("array<string>")))).withColumn("n_id", T.normalized(F.col("id"))).withColumn("n_path", T.normalized(F.col("path")))
    rows = rows.withColumn("t_label", T.terms(F.col("label"))).withColumn("t_alias", T.terms(F.array_join("aliases", " "))).withColumn("t_descr", T.terms(F.col("descr"))).withColumn("t_path", T.terms(F.col("path"))).withColumn("t_id", T.tokens(F.col("id")))
    return rows.withColumn("bare", F.when(F.col("kind") == "file", F.col("stem")).when(F.col("kind") == "layer", F.lower(F.substring_index("label", "/", -1))))


#: Names below this length are found by what is left when a letter goes, longer ones by their pieces; from BOTH on, by both.
SHORT, BOTH = 10, 8


def shared_keys(name: Column, asked: bool) -> Column:
    """Keys of which a name and a text that may pass for its misspelling share one, so that the two meet by an equal join.

    At most two edits apart, and two only where the longer has ten letters or more. One edit: leaving out one letter or none, both
    come to the same. Two: of three pieces of the name one is in the text, moved by two at most; it has two letters at least. A
    name has eleven keys at most, few of them short; a text that is ``asked`` for tries every piece of every fitting length.
    """
    whole, three = F.length(name), F.sequence(F.lit(0), F.lit(2))
    less = F.transform(F.sequence(F.lit(1), whole), lambda i: F.concat(F.lit("-"), F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, whole)))
    less = F.array_distinct(F.concat(F.array(F.concat(F.lit("-"), name)), less))
    size = lambda n, i: F.when(i < 2, F.floor(n / 3)).otherwise(n - 2 * F.floor(n / 3)).cast("int")
    start = lambda n, i: (1 + i * F.floor(n / 3)).cast("int")
    key = lambda n, i, p: F.concat_ws("|", n.cast("string"), i.cast("string"), F.substring(name, p, size(n, i)))
    none = F.array().cast("array<string>")
    if not asked:
        own = F.transform(three, lambda i: key(whole, i, start(whole, i)))
        return F.concat(F.when(whole < SHORT, less).otherwise(none), F.when(whole >= BOTH, own).otherwise(none))
    fits = lambda n, i: F.filter(F.sequence(start(n, i) - 2, start(n, i) + 2), lambda p: (p >= 1) & (p + size(n, i) - 1 <= whole))
    of = lambda n: F.flatten(F.transform(three, lambda i: F.transform(fits(n, i), lambda p: key(n, i, p))))
    tried = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(BOTH), whole - 2), F.greatest(F.lit(BOTH), whole + 2)), of)))
    return F.concat(F.when(whole <= SHORT, less).otherwise(none), F.when(whole >= BOTH, tried).otherwise(none))


def distance(a: Column, b: Column) -> Column:
    """Edit distance up to 2, else 3."""
    d = F.levenshtein(a, b, 2)
    return F.when(d < 0, 3).otherwise(d)


def near_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, d, ...) of strings wanted(a) and names(b), both distinct, that are one or two edits apart and may pass for a misspelling;
    further columns of both sides must agree.

    Five letters or more; one edit below eight, else two; and at most a fifth of the longer one.
    """
    same = [c for c in names.columns if c != "b"]
    left = wanted.where(F.length("a") >= FUZZY_LEAST).select("a", *same, F.explode(shared_keys(F.col("a"), True)).alias("key"))
    right = names.where(F.length("b") >= FUZZY_LEAST - 1).select("b", *same, F.explode(shared_keys(F.col("b"), False)).alias("key"))
    met = left.join(right, [*same, "key"]).select("a", "b", *same).distinct().withColumn("d", distance(F.col("a"), F.col("b")))
    limit = F.when(F.length("a") < FUZZY_SHORT, 1).otherwise(2)
    return met.where((F.col("d") > 0) & (F.col("d") <= limit) & (F.col("d") / F.greatest(F.length("a"), F.length("b")) <= FUZZY_RATIO))


def requested(texts: DataFrame, index: DataFrame) -> DataFrame:
    """texts(qid, text) with ``name``, ``hint``, and of a request for a file ``query``, the literal name that is asked for; else null."""
    literal = F.filter(F.regexp_extract_all("text", F.lit(r"[^\s`\"'?!,;()]+"), 0), lambda x: x.contains(".") & x.rlike(LITERAL))
    name = T.filename_text(F.col("text"))
    rows = texts.select("qid", "text", name.alias("name"), T.kind_hint(F.col("text")).alias("hint"), literal.alias("literals"))
    rows = rows.withColumn("q", F.when(F.size("literals") == 1, F.element_at("literals", 1)).otherwise(F.col("name")))
    plain = F.col("q").rlike(LITERAL)
    explicit = (F.coalesce("hint", F.lit("")) == "file") | F.col("text").rlike(r"(?i)\bfilename\b") | (F.size("literals") > 0) | (plain & F.col("q").rlike(r"[/.]"))
    rows = rows.withColumn("explicit", explicit).withColumn("plain", plain).withColumn("nq", T.normalized(F.col("q"))).withColumn("nt", T.normalized(F.regexp_replace("text", PREFIX, "")))
    files, layers = index.where("kind = 'file'"), index.where("kind = 'layer'")
    known = files.select(F.explode(F.array("basename", "stem")).alias("q")).distinct().withColumn("known", F.lit(True))
    names = layers.select(F.explode(F.concat(F.array("n_id", "n_label"), "n_aliases")).alias("nq")).distinct().withColumn("l1", F.lit(True))
    aliases = layers.select(F.explode("n_aliases").alias("nt")).distinct().withColumn("l2", F.lit(True))
    last = layers.select(F.col("bare").alias("q")).distinct().withColumn("l3", F.lit(True))
    rows = rows.join(known, "q", "left").join(names, "nq", "left").join(aliases, "nt", "left").join(last, "q", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    layer = on("l1") | on("l2") | (on("l3") & (F.coalesce("hint", F.lit("")) == "layer"))
    rows = rows.withColumn("layer", layer).withColumn("named", on("l1")).withColumn("known", on("known"))
    shaped = F.col("plain") & (F.col("q").rlike("_|[a-z][A-Z]") | (F.col("q").contains("-") & ~F.col("layer")))
    rows = rows.withColumn("shaped", shaped).withColumn("low", F.lower("q"))
    open_ = ~F.col("explicit") & ~F.col("known") & ~F.col("shaped") & ~F.col("layer") & F.col("plain")
    near = near_names(rows.where(open_).select(F.col("low").alias("a")).distinct(), files.select(F.lower("stem").alias("b")).distinct()).select(F.col("a").alias("low")).distinct().withColumn("near", F.lit(True))
    rows = rows.join(near, "low", "left").withColumn("near", on("near") & open_)
    is_file = F.col("explicit") | (F.col("known") & ~F.col("layer")) | F.col("shaped") | F.col("near")
    return rows.select("qid", "text", "name", "hint", F.when(is_file, F.col("q")).alias("query"), "explicit", "named")


def file_scores(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, idx, id, tier, score) of requests(qid, query): the best tier of each file that has one."""
    base = F.substring_index("query", "/", -1)
    rows = requests.where("query is not null").select("qid", "query", base.alias("base"), F.regexp_replace(base, r"\.[^.]+$", "").alias("stem"), F.col("query").contains("/").alias("pathed"))
    rows = rows.withColumn("ext", F.when(F.col("base").contains("."), F.concat(F.lit("."), F.substring_index("base", ".", -1))).otherwise("")).withColumn("words", T.tokens(F.col("stem")))
    files = index.where("kind = 'file'").select("idx", "id", "literal", "basename", F.col("stem").alias("own"), "stem_tokens")
    plain = F.regexp_replace("literal", r"\.[^.]+$", "")

    def met(where, key, other, tier):
        return rows.where(where).join(files, key == other).select("qid", "idx", "id", F.lit(tier).alias("tier"), F.lit(FILE[tier]).alias("score"))

    found = [
        met("pathed", F.col("query"), F.col("literal"), "path"),
        met("not pathed", F.col("query"), F.col("basename"), "basename"),
        met("ext = '' and pathed", F.col("query"), plain, "stem"),
        met("ext = '' and not pathed", F.col("query"), F.col("own"), "stem"),
    ]
    partial = rows.where(~F.col("pathed") & (F.length("stem") >= PART))
    fits = (F.col("ext") == "") | F.col("basename").endswith(F.col("ext"))
    by_word = partial.where(F.size("words") > 0).join(files.withColumn("word", F.explode(F.array_distinct("stem_tokens"))), F.element_at("words", 1) == F.col("word")).where(fits & F.forall("words", lambda w: F.array_contains("stem_tokens", w)))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("own") - PART + 1, F.lit(1))), lambda i: F.substring("own", i, F.lit(PART))))
    by_run = partial.join(files.where(F.length("own") >= PART).withColumn("run", F.explode(runs)), F.substring(F.lower("stem"), 1, PART) == F.col("run")).where(fits & F.col("own").contains(F.lower("stem")))
    for df in (by_word, by_run):
        found.append(df.select("qid", "idx", "id", F.lit("partial").alias("tier"), F.lit(FILE["partial"]).alias("score")))
    # Misspelt paths, names with an extension and names without one, in one join.
    against = F.when(F.col("pathed"), "literal").when(F.col("ext") != "", "basename").otherwise("own")
    asked = rows.select("qid", against.alias("field"), F.lower("query").alias("a"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("b")) for f in ("literal", "basename", "own")])
    named_ = files.select("idx", "id", F.explode(fields).alias("n")).select("idx", "id", "n.field", "n.b")
    near = near_names(asked.select("a", "field").distinct(), named_.select("b", "field").distinct())
    met_ = asked.join(near, ["field", "a"]).join(named_, ["field", "b"])
    found.append(met_.select("qid", "idx", "id", F.lit("fuzzy").alias("tier"), (FILE["fuzzy"] - F.col("d")).alias("score")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("qid", "idx", "id").agg(F.max(F.struct("score", "tier")).alias("b")).select("qid", "idx", "id", "b.tier", "b.score")


def missing_exact(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """(qid, missing): whether a request names an extension or folder and no file is that one."""
    base = F.substring_index("query", "/", -1)
    strict = base.contains(".") | F.col("query").contains("/")
    ok = F.col("tier").isin("path", "basename") | (~base.contains(".") & (F.col("tier") == "stem"))
    hit = scored.join(requests.select("qid", "query"), "qid").where(ok).select("qid").distinct().withColumn("hit", F.lit(True))
    return requests.join(hit, "qid", "left").select("qid", (strict & F.col("hit").isNull()).alias("missing"))


def bare_candidates(texts: DataFrame, index: DataFrame, folder_tree: bool = False) -> DataFrame:
    """(qid, idx, id, kind) of texts(qid, name, hint): nodes whose bare name it is, those of the kind that is hinted at if there are any."""
    nodes = index.where("bare is not null and bare <> ''").select("idx", "id", "kind", "bare", F.lower("label").alias("full"))
    met = texts.where(F.col("name").rlike(r"^\.?[\w-]+$")).join(nodes, F.col("name") == F.col("bare"))
    every = Window.partitionBy("qid")
    told = met.withColumn("likes", F.coalesce(F.col("kind") == F.col("hint"), F.lit(False))).withColumn("whole", F.col("likes") & (F.col("kind") == "layer") & (F.col("full") == F.col("name")))
    told = told.withColumn("any_likes", F.max("likes").over(every)).withColumn("any_whole", F.max("whole").over(every) & F.lit(not folder_tree))
    keep = F.when(F.col("any_whole"), F.col("whole")).when(F.col("any_likes"), F.col("likes")).otherwise(True)
    return told.where(keep).select("qid", "idx", "id", "kind")


def architecture_scores(texts: DataFrame, index: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(qid, idx, id, label_, alias_, descr_, path_, identity_, structural, score, evidence, coverage, exact) of texts(qid, text, name, hint).

    Groups only, and of these any that shares a term or a name with the text. prior(id, prior): a small weight for what is used.
    """
    raw, strip = T.normalized(F.col("text")), T.normalized(F.regexp_replace("text", PREFIX, ""))
    q = texts.withColumn("q", T.terms(F.col("text"))).withColumn("raw", raw).withColumn("original", strip).withColumn("phrase", F.array_join("q", " "))
    q = q.withColumn("literal_q", F.array_join(T.tokens(F.col("name")), " "))
    layers = index.where("kind = 'layer'")
    if prior is not None:
        layers = layers.join(prior.select(F.col("id").alias("p_id"), "prior"), F.col("id") == F.col("p_id"), "left").drop("p_id")
    else:
        layers = layers.withColumn("prior", F.lit(0.0))
    words = lambda *c: F.array_distinct(F.concat(*c))
    names = F.concat(F.array("n_label", "n_id"), "n_aliases")
    own = layers.select("idx", F.explode(words("t_label", "t_alias", "t_descr", "t_path", "t_id", names, F.array(F.lower(F.substring_index("label", "/", -1))), T.tokens(F.col("n_path")))).alias("key"))
    asked = q.select("qid", F.explode(words("q", F.array("raw", "original", "phrase", "name"), T.tokens(F.col("raw")))).alias("key"))
    pairs = asked.where("key <> ''").join(own, "key").select("qid", "idx").distinct()
    rows = pairs.join(q, "qid").join(layers, "idx")
    over = lambda c: F.when(F.size("q") > 0, F.size(F.filter("q", lambda t: F.array_contains(c, t))) / F.size("q")).otherwise(0.0)
    is_ = lambda c: (c != "") & ((c == F.col("raw")) | (c == F.col("phrase")) | (c == F.col("original")))
    inside = lambda c: (c != "") & F.concat(F.lit(" "), "raw", F.lit(" ")).contains(F.concat(F.lit(" "), c, F.lit(" ")))
    whole = F.max((F.lower("label") == F.col("name")).cast("int")).over(Window.partitionBy("qid")) == 1
    last = (F.coalesce("hint", F.lit("")) == "layer") & ~whole & (F.lower(F.substring_index("label", "/", -1)) == F.col("name"))
    rows = rows.withColumn("label_", F.when(last, 12.0).when(is_(F.col("n_label")), 8.0).otherwise(4 * over(F.col("t_label"))))
    rows = rows.withColumn("alias_", F.when(F.exists("n_aliases", is_), 9.0).otherwise(4.5 * over(F.col("t_alias")))).withColumn("descr_", 1.5 * over(F.col("t_descr")))
    rows = rows.withColumn("path_", F.when(inside(F.col("n_path")), 14.0).otherwise(3 * over(F.col("t_path"))))
    rows = rows.withColumn("identity_", F.when(is_(F.col("n_id")) | ((F.coalesce("path", F.lit("")) != "") & inside(F.col("n_id"))), 11.0).otherwise(0.0))
    rows = rows.withColumn("evidence", F.col("label_") + F.col("alias_") + F.col("descr_") + F.col("path_") + F.col("identity_"))
    rows = rows.withColumn("structural", F.when(F.col("evidence") > 0, F.coalesce("prior", F.lit(0.0))).otherwise(0.0))
    exact = lambda c: (F.coalesce(c, F.lit("")) != "") & (F.array_join(T.tokens(c), " ") == F.col("literal_q"))
    coverage = over(words("t_label", "t_alias", "t_descr", "t_path", "t_id"))
    rows = rows.withColumn("exact", exact(F.col("label")) | F.exists("aliases", exact) | exact(F.col("id"))).withColumn("coverage", coverage)
    return rows.where("evidence > 0").select("qid", "idx", "id", "label_", "alias_", "descr_", "path_", "identity_", "structural", (F.col("evidence") + F.col("structural")).alias("score"), "evidence", "coverage", "exact")


SCORED = ("qid", "idx", "id", "score", "evidence", "coverage", "tier", "exact", "mode", "missing", "branch")


def named(rows: DataFrame, branch: str, score: float) -> DataFrame:
    """Candidates of a literal name as scored rows."""
    return rows.select("qid", "idx", "id", F.lit(score).alias("score"), F.lit(score).alias("evidence"), F.lit(1.0).alias("coverage"), F.lit("lexical").alias("tier"), F.lit(True).alias("exact"), F.lit("architecture").alias("mode"), F.lit(False).alias("missing"), F.lit(branch).alias("branch"))


def rank_literal(texts: DataFrame, index: DataFrame, aliases: DataFrame | None = None, prior: DataFrame | None = None, folder_tree: bool = False) -> DataFrame:
    """Scored rows of texts(qid, text), of the first branch that a text belongs to: full folder path, learned alias unless a real file
    is meant, bare name of several kinds, file, responsibility of a group. aliases(alias, node): learned ones, normalised.
    """
    if folder_tree:
        texts = texts.select("qid", F.regexp_replace("text", r"(?i)^the\s+", "").alias("text"))
    asked = cut(requested(texts, index))
    layers, files = index.where("kind = 'layer'"), index.where("kind = 'file'")
    real_path = index.select(F.col("literal").alias("name")).where("name <> ''").distinct()
    folders = asked.where(F.col("name").contains("/")).join(real_path, "name", "left_anti").join(layers.select("idx", "id", F.lower("label").alias("name")), "name")
    by_path = cut(named(folders, "folder path", FULL_PATH))

    real = asked.where("query is not null").withColumn("pathed", F.col("query").contains("/"))
    names = files.select(F.explode(F.array(F.struct(F.lit(True).alias("pathed"), F.col("literal").alias("query")), F.struct(F.lit(False).alias("pathed"), F.col("basename").alias("query")))).alias("k")).select("k.*").distinct()
    real = real.join(names, ["pathed", "query"], "left_semi").select("qid")
    rest = asked.join(by_path.select("qid").distinct(), "qid", "left_anti")
    parts = [by_path]
    if aliases is not None:
        key = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
        learned = rest.join(real, "qid", "left_anti").select("qid", key.alias("alias")).join(aliases.select("alias", F.col("node").alias("id")).distinct(), "alias").join(index.select("idx", "id"), "id")
        parts.append(cut(named(learned, "learned alias", ALIAS)))
        rest = rest.join(parts[-1].select("qid").distinct(), "qid", "left_anti")
    rest = cut(rest)

    bare = cut(bare_candidates(rest, index, folder_tree))
    kinds = bare.groupBy("qid").agg(F.count_distinct("kind").alias("kinds"), F.max((F.col("kind") == "layer").cast("int")).alias("layers"))
    told = kinds.join(rest.select("qid", "hint"), "qid").where((F.col("kinds") > 1) | ((F.col("layers") == 1) & (F.lit(folder_tree) | (F.coalesce("hint", F.lit("")) == "layer"))))
    parts.append(named(bare.join(told.select("qid"), "qid", "left_semi"), "bare name", NAME))
    rest = cut(rest.join(told.select("qid"), "qid", "left_anti"))

    wanted = rest.where("query is not null")
    scored = cut(file_scores(wanted, index))
    strict = cut(missing_exact(wanted, scored))
    lost = wanted.join(scored.select("qid").distinct(), "qid", "left_anti").where(~F.col("query").rlike(r"[/.]") & F.col("named")).select("qid")
    as_file = cut(wanted.join(lost, "qid", "left_anti").select("qid"))
    found = scored.join(as_file, "qid", "left_semi").join(strict, "qid")
    parts.append(found.select("qid", "idx", "id", "score", F.col("score").alias("evidence"), F.lit(1.0).alias("coverage"), "tier", F.col("tier").isin("path", "basename").alias("exact"), F.lit("filename").alias("mode"), "missing", F.lit("file").alias("branch")))
    # A file that is asked for and not there is an answer too: that there is none.
    none = as_file.join(scored.select("qid").distinct(), "qid", "left_anti").join(strict, "qid")
    empty = none.select("qid", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("evidence"), F.lit(0.0).alias("coverage"), F.lit("none").alias("tier"), F.lit(False).alias("exact"), F.lit("filename").alias("mode"), "missing", F.lit("file").alias("branch"))
    parts.append(empty)
    rest = rest.join(as_file, "qid", "left_anti")

    scores = architecture_scores(rest, index, prior)
    parts.append(scores.select("qid", "idx", "id", "score", "evidence", "coverage", F.lit("lexical").alias("tier"), "exact", F.lit("architecture").alias("mode"), F.lit(False).alias("missing"), F.lit("responsibility").alias("branch")))
    return reduce(DataFrame.unionByName, [p.select(*[F.col(c) if c != "idx" else F.col(c).cast("long").alias("idx") for c in SCORED]) for p in parts])


def finished(scored: DataFrame) -> DataFrame:
    """scored with ``rank``, ``margin`` and ``yes`` of the best row, ``label`` of its text, and ``suggested``: which rows are proposed.

    Yes takes evidence, coverage and a margin to the runner-up, no missing name and no misspelling.
    """
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("idx").asc_nulls_last())
    every = Window.partitionBy("qid")
    rows = scored.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    present = (F.col("evidence") > 0) & (F.col("coverage") >= COVERED)
    rows = rows.withColumn("present", present).withColumn("top", F.max("score").over(every)).withColumn("n_present", F.count_if("present").over(every))
    rows = rows.withColumn("tied", F.col("present") & (F.col("score") == F.col("top"))).withColumn("n_tied", F.count_if("tied").over(every))
    best = (F.col("evidence") >= EVIDENCE) & (F.col("coverage") >= COVERED) & (F.col("margin") >= MARGIN) & ~F.col("missing") & (F.col("tier") != "fuzzy")
    rows = rows.withColumn("yes", F.max(F.when(F.col("rank") == 1, best)).over(every))
    label = F.when(F.col("yes"), F.when(F.max(F.when(F.col("rank") == 1, F.col("exact"))).over(every), "Exact match").otherwise("Likely match")).when(F.col("n_present") > 0, "Needs your choice").otherwise("No match")
    rows = rows.withColumn("label", label)
    # Of those present, in order: all that tie and others up to three; without a tie the first three.
    place = F.row_number().over(Window.partitionBy("qid", "present").orderBy(F.col("score").desc(), "idx"))
    loose = (F.col("mode") == "filename") | (F.col("n_tied") > 1)
    suggested = F.col("present") & F.when(loose, F.col("tied") | (place <= F.greatest(F.lit(3), F.col("n_tied")))).otherwise(place <= 3)
    return rows.withColumn("suggested", suggested).drop("top", "n_present", "tied", "n_tied", "present")


def rank(texts: DataFrame, index: DataFrame, aliases: DataFrame | None = None, prior: DataFrame | None = None, folder_tree: bool = False) -> DataFrame:
    """Finished rows of texts(qid, text). A text that literally matches nothing is tried with one word replaced by a synonym, which
    counts three quarters; of several ways to a node the best counts."""
    first = cut(finished(rank_literal(texts, index, aliases, prior, folder_tree)))
    hopeful = first.where("label <> 'No match'")
    rest = texts.join(hopeful.select("qid").distinct(), "qid", "left_anti")
    variants = rest.select("qid", F.posexplode(T.synonym_variants(F.col("text"))).alias("n", "v")).select(F.col("qid").alias("of"), F.struct("qid", "n").alias("qid"), "v.text")
    told = variants.select("qid", "of", "text", T.filename_text(F.col("text")).alias("name"), T.kind_hint(F.col("text")).alias("hint"))
    told = cut(told)
    bare = named(bare_candidates(told, index, folder_tree), "bare name", NAME)
    others = told.join(bare.select("qid").distinct(), "qid", "left_anti").select("qid", "text")
    tried = finished(bare.unionByName(rank_literal(others, index, aliases, prior, folder_tree))).where("suggested")
    head = Window.partitionBy("qid")
    tried = tried.withColumn("covered", F.max(F.when(F.col("rank") == 1, F.col("coverage"))).over(head)).withColumn("kind_of", F.max(F.when(F.col("rank") == 1, F.col("tier"))).over(head))
    best = tried.groupBy(F.col("qid.qid").alias("qid"), "idx", "id").agg(F.max_by(F.struct("score", "covered", F.when(F.col("missing"), "fuzzy").otherwise(F.col("kind_of")).alias("tier")), F.struct("score", -F.col("qid.n"))).alias("b"))
    again = best.select("qid", "idx", "id", (F.col("b.score") * SYNONYM).alias("score"), (F.col("b.score") * SYNONYM).alias("evidence"), F.col("b.covered").alias("coverage"), "b.tier", F.lit(False).alias("exact"), F.lit("architecture").alias("mode"), F.lit(False).alias("missing"), F.lit("synonym").alias("branch"))
    return hopeful.unionByName(finished(again))


def heads(texts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, label, yes, choice, branch, tier, margin, suggestions, n_suggestions) for each text, those without any row too."""
    top = ranked.where("rank = 1").select("qid", "label", "yes", F.when(F.col("score") > 0, F.col("id")).alias("choice"), "branch", "tier", "margin", "missing")
    listed = ranked.where("suggested").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "idx", "id"))).alias("l"))
    ids = F.transform("l", lambda x: x["id"])
    rows = texts.select("qid").join(top, "qid", "left").join(listed, "qid", "left")
    return rows.select("qid", F.coalesce("label", F.lit("No match")).alias("label"), F.coalesce("yes", F.lit(False)).alias("yes"), "choice", F.coalesce("branch", F.lit("responsibility")).alias("branch"), F.coalesce("tier", F.lit("lexical")).alias("tier"), F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("missing", F.lit(False)).alias("missing"), F.coalesce(ids, F.array().cast("array<string>")).alias("suggestions"))


#: What a question about calls means where its ends are files or folders.
FOR_FILES = {"CALLERS": "DOWNSTREAM", "CALLEES": "UPSTREAM", "TRACE": "UPSTREAM", "FLOW": "PATH"}


def symbol_names(symbols: DataFrame) -> DataFrame:
    """(id, key): every normalised name of symbols(id, name, qualname, path)."""
    keys = F.array_distinct(F.array("id", "name", "qualname", F.concat_ws(":", "path", "qualname")))
    return symbols.select("id", F.explode(F.transform(keys, T.normalize_question)).alias("key")).distinct()


def _names_alone(asked: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """(normal) of asked(normal) that are a definition's name and no node's id: no more rows than are asked."""
    own = names.select(F.col("key").alias("normal")).join(asked.select("normal").distinct(), "normal").distinct()
    return own.join(index.select(F.col("id").alias("normal")), "normal", "left_anti")


def requests(questions: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, question, normal, i, s) of questions(qid, question): what is asked of files and groups, and of definitions if it may be.

    A question that is nothing but a definition's name, and no node's id, asks where that is.
    """
    asked = questions.select("qid", "question", T.normalize_question(F.col("question")).alias("normal"))
    asked = asked.join(_names_alone(asked, index, names).withColumn("whole", F.lit(True)), "normal", "left")
    asked = asked.withColumn("i", T.intent(F.col("normal"))).withColumn("s", T.symbol_request(F.col("normal")))
    asked = cut(asked)  # the grammar is a long expression: it is worked out once, not wherever a part of it is read
    bare = F.struct(F.lit("LOCATE").alias("op"), F.col("normal").alias("first"), F.lit(None).cast("string").alias("second"))
    return asked.select("qid", "question", "normal", "i", F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("whole"), bare).alias("s"))


def resolved(questions: DataFrame, index: DataFrame, symbols: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(qid, op, file_op, outcome, ids, ends) of questions(qid, question): whether names alone tell the graph that is meant.

    index: files and groups; symbols(id, name, qualname, path). A bare name that several kinds of node have is a choice, those of the
    kind that is hinted at first. Else a definition's own name counts, then an exact node. outcome: scored (left to the scorer),
    needs-choice, unresolved, unsupported (a definition and a file), symbols or files; ids: of the first end that is not one node,
    else of all. ends: (place, text, ids) of each end.
    """
    names = wide(cut(symbol_names(symbols)))
    asked = requests(questions, index, names)
    none = F.lit(None).cast("string")
    lost = (F.col("i.op") == "PATH") & F.col("i.from").isNull()
    asked = asked.where(~lost).withColumn("op", F.coalesce("s.op", "i.op"))
    asked = asked.withColumn("ends", F.when(F.col("s").isNotNull(), F.array("s.first", "s.second")).when(F.col("i.op") == "PATH", F.array("i.from", "i.to")).otherwise(F.array("i.target", none)))
    asked = cut(asked.select("qid", "op", F.col("i.op").alias("intent"), F.col("s").isNotNull().alias("by_symbol"), T.kind_hint(F.col("question")).alias("q_hint"), F.filter("ends", lambda e: e.isNotNull()).alias("ends")))
    ends = asked.select("qid", "op", "q_hint", F.posexplode("ends").alias("place", "text"))
    ends = ends.withColumn("name", T.filename_text(F.col("text"))).withColumn("hint", F.coalesce(T.kind_hint(F.col("text")), F.when(F.col("op") == "LOCATE", F.col("q_hint")))).withColumn("own_hint", T.kind_hint(F.col("text")))
    ends = ends.withColumn("key", T.normalize_question(F.col("text")))
    if aliases is not None:
        ends = ends.join(aliases.select(F.col("alias").alias("name"), F.lit(True).alias("alias")).distinct(), "name", "left")
    else:
        ends = ends.withColumn("alias", F.lit(None).cast("boolean"))
    ends = cut(ends)
    nodes = index.select("id", "kind", F.col("bare").alias("name")).unionByName(symbols.select("id", F.lit("symbol").alias("kind"), F.lower("name").alias("name")))
    nodes = wide(nodes)  # a union keeps no hint of its parts
    literal = ends.where(F.col("alias").isNull() & F.col("name").rlike(r"^\.?[\w-]+$")).join(nodes.where("name <> ''"), "name")
    every = Window.partitionBy("qid", "place")
    literal = literal.withColumn("kinds", F.size(F.collect_set("kind").over(every))).where("kinds > 1").withColumn("likes", F.coalesce(F.col("kind") == F.col("hint"), F.lit(False))).withColumn("any", F.max("likes").over(every)).where("likes or not any")
    collided = literal.select("qid", "place", "id", F.lit(0).alias("order"))
    by_name = ends.join(names, "key").select("qid", "place", "id", F.lit(1).alias("order"))
    by_hint = ends.where("hint = 'symbol'").join(names.withColumnRenamed("key", "name"), "name").select("qid", "place", "id", F.lit(2).alias("order"))
    exact = index.select("id", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower(F.coalesce("path", F.lit(""))), F.when(F.col("kind") == "layer", F.lower("label")).otherwise("")))).alias("name")).where("name <> ''")
    by_node = ends.join(exact, "name").select("qid", "place", "id", F.lit(3).alias("order"))
    found = collided.unionByName(by_name).unionByName(by_hint).unionByName(by_node).distinct()
    first = found.groupBy("qid", "place").agg(F.min("order").alias("best"))
    found = found.join(first, ["qid", "place"]).where("order = best")
    is_symbol = found.join(symbols.select("id", F.lit(1).alias("sym")).distinct(), "id", "left")
    told = is_symbol.groupBy("qid", "place").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max((F.col("order") == 0).cast("int")).alias("collision"), F.min(F.coalesce("sym", F.lit(0))).alias("symbol"))
    node_ids = index.select(F.col("id").alias("name"), F.lit(True).alias("is_id"))
    rows = ends.join(node_ids, "name", "left").join(told, ["qid", "place"], "left").withColumn("n", F.coalesce(F.size("ids"), F.lit(0)))
    rows = rows.withColumn("n", F.when(F.col("ids").isNull(), 0).otherwise(F.col("n")))
    canonical = (F.coalesce("own_hint", F.lit("")) == "layer") & F.coalesce("is_id", F.lit(False))
    per = rows.groupBy("qid").agg(
        F.max(F.coalesce("collision", F.lit(0))).alias("collision"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.coalesce("symbol", F.lit(0))).alias("some"), F.min(F.coalesce("symbol", F.lit(0))).alias("every_"), F.max(canonical.cast("int")).alias("canonical"),
        F.min_by("ids", F.when(F.col("n") > 1, F.col("place")).otherwise(F.lit(9))).alias("choice"), F.array_sort(F.collect_list(F.struct("place", F.get(F.coalesce("ids", F.array().cast("array<string>")), F.lit(0)).alias("id")))).alias("single"),
        F.array_sort(F.collect_list(F.struct("place", "text", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")))).alias("ends"),
    )
    rows = asked.drop("ends").join(per, "qid").withColumn("file_op", F.coalesce(*[F.when(F.col("op") == k, v) for k, v in FOR_FILES.items()], F.col("op")))
    explicit = (F.col("least") == 1) & (F.col("most") == 1) & ((F.col("canonical") == 1) | (F.col("by_symbol") & (F.col("op") != "LOCATE") & (F.col("intent") != F.col("file_op"))) | ((F.col("intent") != "LOCATE") & (F.col("some") == 1)))
    outcome = F.when((F.col("collision") == 0) & ~explicit, "scored").when(F.col("most") > 1, "needs-choice").when(F.col("least") == 0, "unresolved").when(F.col("some") != F.col("every_"), "unsupported").when(F.col("some") == 1, "symbols").otherwise("files")
    rows = rows.withColumn("outcome", outcome)
    ids = F.when(F.col("outcome") == "needs-choice", F.col("choice")).when(F.col("outcome").isin("symbols", "files"), F.transform("single", lambda x: x["id"]))
    return rows.select("qid", "op", "file_op", "outcome", ids.alias("ids"), "ends")
