"""Queries of logs and evaluation: folds, retention, accuracy, grids, percentiles, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from archlens.functions import text as T
from archlens.operators import graph, qlog, quantiles
from archlens.plans.base import query
from archlens.plans.text import NORMAL, PHRASES, duck_intent
from archlens.sources.tables import code_files, table
from archlens.sources.pointers import FeedbackStore
from archlens.streaming.log_sink import LogSink, answered
from archlens.streaming.question_log import folded_stream

LOG = "log as (select user_id as entry_id, case event_type when 'signup' then 'question' else 'verdict' end as kind, case when event_type = 'purchase' then case event_id % 3 when 0 then 'match' when 1 then 'unsure' else 'no match' end end as label, event_id as seq, ts as asked from events where event_type in ('signup', 'purchase'))"


def log(spark, sf_dir):
    label = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 3 == 0, "match").when(F.col("event_id") % 3 == 1, "unsure").otherwise("no match"))
    return table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("entry_id"), F.when(F.col("event_type") == "signup", "question").otherwise("verdict").alias("kind"), label.alias("label"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))


FOLD = f"with {LOG}, q as (select entry_id, max(seq) as seq from log where kind = 'question' group by 1), v as (select l.entry_id, arg_max(label, l.seq) as verdict from log l join q on l.entry_id = q.entry_id and l.seq > q.seq where kind = 'verdict' group by 1)"


@query("log_fold", FOLD + " select q.entry_id, q.seq, verdict from q left join v using (entry_id)")
def log_fold(spark, sf_dir):
    return qlog.folded(log(spark, sf_dir)).select("entry_id", "seq", "verdict")


@query("log_latest_verdict", FOLD + " select verdict, count(*) as n from v group by 1")
def log_latest_verdict(spark, sf_dir):
    return qlog.folded(log(spark, sf_dir)).where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"))


@query("log_dropped", FOLD + " select l.entry_id, l.seq from log l left join (select entry_id, min(seq) as first from log where kind = 'question' group by 1) f using (entry_id) where kind = 'verdict' and (first is null or l.seq < first)")
def log_dropped(spark, sf_dir):
    """Verdicts that come before any question of their entry."""
    rows = log(spark, sf_dir)
    first = rows.where("kind = 'question'").groupBy("entry_id").agg(F.min("seq").alias("first"))
    return rows.where("kind = 'verdict'").join(first, "entry_id", "left").where("first is null or seq < first").select("entry_id", "seq")


@query("log_retention", "with e as (select event_id, event_type, ts, octet_length(encode(props)) as bytes from events), y as (select *, max(ts) over (partition by event_type) as last from e), c as (select event_id, event_type, bytes, row_number() over w as n, sum(bytes) over w as b from y where ts >= last - interval 90 days window w as (partition by event_type order by event_id desc rows between unbounded preceding and current row)) select event_id, event_type from c where n <= 200 and b <= 1500")
def log_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.octet_length("props").alias("bytes"))
    return qlog.retained(rows, "event_type", "ts", "bytes", "event_id", bytes_=1500).select("event_id", "event_type")


@query("log_newest", f"with {LOG} select kind, seq, rank from (select kind, seq, row_number() over (partition by kind order by asked desc, seq desc) as rank from log) where rank <= 20")
def log_newest(spark, sf_dir):
    """The twenty newest entries of either kind."""
    order = Window.partitionBy("kind").orderBy(F.desc("at"), F.desc("seq"))
    return log(spark, sf_dir).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 20").select("kind", "seq", "rank")


@query("log_stream", FOLD + " select q.entry_id, q.seq, verdict from q left join v using (entry_id)")
def log_stream(spark, sf_dir):
    """The same fold by Structured Streaming over the events as they are read; the last state of each entry."""
    schema = table(spark, sf_dir, "events").schema
    name = f"log_{uuid.uuid4().hex}"
    label = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 3 == 0, "match").when(F.col("event_id") % 3 == 1, "unsure").otherwise("no match"))
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    entries = stream.where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("entry_id"), F.when(F.col("event_type") == "signup", "question").otherwise("verdict").alias("kind"), label.alias("label"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    run = folded_stream(entries).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).groupBy("entry_id").agg(F.max("seq").alias("seq"), F.max_by("verdict", "seq").alias("verdict"))


@query("verdict_stream", f"with {LOG} select q.entry_id, q.seq, v.seq as verdict_seq, v.label from log q join log v using (entry_id) where q.kind = 'question' and v.kind = 'verdict' and v.asked >= q.asked and v.asked <= q.asked + interval 7 days")
def verdict_stream(spark, sf_dir):
    """Verdicts joined to their questions as two streams over the log, which arrives in four slices of time; written exactly once, read back."""
    rows = graph.cut(log(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")))
    ends = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    base = f"{graph.shared_folder(spark)}/verdicts-{uuid.uuid4().hex}"
    step = (ends["b"] - ends["a"]) / 4
    for i in range(4):
        inside = (F.col("at") >= F.lit(ends["a"] + i * step)) & ((F.col("at") < F.lit(ends["a"] + (i + 1) * step)) | F.lit(i == 3))
        rows.where(inside).write.mode("append").parquet(f"{base}/in")
    stream = lambda kind: spark.readStream.schema(rows.schema).parquet(f"{base}/in").where(F.col("kind") == kind)
    sink = LogSink(spark, f"{base}/out")
    run = answered(stream("question"), stream("verdict")).writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return sink.read("entry_id long, seq long, verdict_seq long, label string").select("entry_id", "seq", "verdict_seq", "label")


@query(
    "feedback_import",
    """with a as (select doc_id as id, case when doc_id % 4 = 0 then 'holdout' else 'dev' end as split, quality as label from labels where doc_id % 3 <> 0), b as (select doc_id as id, 'dev' as split, 1 - quality as label from labels where doc_id % 2 = 0)
    select coalesce(a.id, b.id) as id, case when b.id is null or a.split = 'holdout' then a.split else b.split end as split, case when b.id is null or a.split = 'holdout' then a.label else b.label end as label,
      case when b.id is null then 'kept' when a.id is null then 'add' when a.split = 'holdout' then 'refused' else 'replace' end as action from a full join b using (id)""",
)
def feedback_import(spark, sf_dir):
    """Feedback imported in two steps; a second import that saw the same version is refused, held-out records stay."""
    labels = table(spark, sf_dir, "labels")
    first = labels.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "holdout").otherwise("dev").alias("split"), F.col("quality").alias("label"))
    second = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("dev").alias("split"), (1 - F.col("quality")).alias("label"))
    store = FeedbackStore(spark, f"{graph.shared_folder(spark)}/feedback-{uuid.uuid4().hex}", "id long, split string, label int")
    store.commit(first, 0)
    seen, shown = store.preview(second)
    shown = graph.cut(shown)
    took, again = store.commit(second, seen), store.commit(first, seen)
    rows = store.table()[1].join(shown, "id", "left").select("id", "split", "label", F.coalesce("action", F.lit("kept")).alias("action"))
    return rows if took and not again else rows.where("false")


GOLD = "gold as (select l.doc_id as case_id, l.quality as expected, case when d.n_chars > 1500 then 1 else 0 end as actual, case when l.doc_id % 4 = 0 then 'holdout' else 'dev' end as split, d.lang as kind, l.toxic from labels l join documents d using (doc_id))"


def gold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("expected"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("actual"), F.when(F.col("doc_id") % 4 == 0, "holdout").otherwise("dev").alias("split"), F.col("lang").alias("kind"), "toxic")


METRICS = "count(*) as n, count_if(expected = actual) as correct, count_if(expected = 0 and actual = 1) as false_accepts, count_if(actual = 0) as abstained, round(count_if(expected = actual) / count(*), 6) as accuracy"


def metrics():
    right = F.count_if(F.col("expected") == F.col("actual"))
    return [F.count("*").alias("n"), right.alias("correct"), F.count_if((F.col("expected") == 0) & (F.col("actual") == 1)).alias("false_accepts"), F.count_if(F.col("actual") == 0).alias("abstained"), F.round(F.try_divide(right, F.count("*")), 6).alias("accuracy")]


def cast_counts(sql):
    return sql.replace("count_if(expected = actual) as", "cast(count_if(expected = actual) as bigint) as").replace("count_if(expected = 0 and actual = 1) as", "cast(count_if(expected = 0 and actual = 1) as bigint) as").replace("count_if(actual = 0) as", "cast(count_if(actual = 0) as bigint) as")


@query("eval_by_split", cast_counts(f"with {GOLD} select split, {METRICS} from gold group by 1"))
def eval_by_split(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("split").agg(*metrics())


@query("eval_by_kind", cast_counts(f"with {GOLD} select kind, {METRICS} from gold group by 1"))
def eval_by_kind(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("kind").agg(*metrics())


@query("eval_grouping_sets", cast_counts(f"with {GOLD} select split, kind, toxic, {METRICS} from gold group by grouping sets ((split, kind), (split, toxic), (kind), ())"))
def eval_grouping_sets(spark, sf_dir):
    return gold(spark, sf_dir).groupingSets([["split", "kind"], ["split", "toxic"], ["kind"], []], "split", "kind", "toxic").agg(*metrics())


GRID = "with p(k, phrase) as (values " + ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES)) + "), n as (select fid, unnest([path, stem, upper(stem), replace(stem, '_', ' ')]) as name, unnest(['path', 'stem', 'upper', 'spaced']) as form from code_files), g as (select k, form, replace(phrase, '{}', name) as question from n, p), q as (select k, form, " + NORMAL.replace("{}", "question") + " as normal from g)"


@query("grid_summaries", GRID + f", o as (select k, form, {duck_intent().split(', case')[0]} from q) select k, form, op, count(*) as n, count(*) filter (op = case when k in (2, 3, 8) then 'DOWNSTREAM' when k in (4, 5) then 'UPSTREAM' when k in (6, 7, 10) then 'PATH' else 'LOCATE' end) as right_ from o group by grouping sets ((k), (form), (op), (k, form))", ("code_files",))
def grid_summaries(spark, sf_dir):
    """The grid by phrase, form, operation, and phrase by form: how many are read as they are meant."""
    rows = parsed_grid(spark, sf_dir)
    k = F.col("k")
    meant = F.when(k.isin(2, 3, 8), "DOWNSTREAM").when(k.isin(4, 5), "UPSTREAM").when(k.isin(6, 7, 10), "PATH").otherwise("LOCATE")
    return rows.withColumn("ok", F.col("op") == meant).groupingSets([["k"], ["form"], ["op"], ["k", "form"]], "k", "form", "op").agg(F.count("*").alias("n"), F.count_if("ok").alias("right_"))


@query("misaligned_cases", "with b as (select doc_id from labels where doc_id % 7 <> 0), a as (select doc_id from labels where doc_id % 9 <> 0) select 'only before' as rule, count(*) as n from (select * from b except select * from a) union all select 'only after', count(*) from (select * from a except select * from b) union all select 'both', count(*) from (select * from a intersect select * from b)")
def misaligned_cases(spark, sf_dir):
    """Cases of two runs that must be the same ones before they are compared."""
    rows = table(spark, sf_dir, "labels").select("doc_id")
    before, after = rows.where("doc_id % 7 <> 0"), rows.where("doc_id % 9 <> 0")
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n")).select("rule", "n")
    return count("only before", before.subtract(after)).union(count("only after", after.subtract(before))).union(count("both", after.intersect(before)))


@query("latency_percentiles", "select event_type, count(*) as n, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95, round(quantile_disc(value, 0.99), 6) as p99, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(max(value), 6) as max from events where value is not null group by 1")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles by type, by counts in buckets: the values of a type meet in no task."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    told = quantiles.timing(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return told.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean", "sd", "max")])


@query("paired_difference", "with m as (select user_id, median(value) as base from events where event_type = 'view' group by 1) select event_type, count(*) as n, round(avg(value - base), 6) as mean from events join m using (user_id) where event_type <> 'view' group by 1")
def paired_difference(spark, sf_dir):
    """Values less the median of the same user's views."""
    rows = table(spark, sf_dir, "events")
    base = rows.where("event_type = 'view'").groupBy("user_id").agg(F.median("value").alias("base"))
    return rows.where("event_type <> 'view'").join(base, "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("base")), 6).alias("mean"))


@query("slowest", "select event_type, event_id, value, rank from (select *, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 10")
def slowest(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("event_type", "event_id", "value", "rank")


@query("ambiguous_strata", "select role, left(text, 4) as question, count(distinct turn % 3) as labels, count(*) as n from conversations group by 1, 2 having count(distinct turn % 3) > 1")
def ambiguous_strata(spark, sf_dir):
    """Questions that have more than one label."""
    return table(spark, sf_dir, "conversations").groupBy("role", F.substring("text", 1, 4).alias("question")).agg(F.count_distinct(F.col("turn") % 3).alias("labels"), F.count("*").alias("n")).where("labels > 1")


@query("distinct_successes", f"with {GOLD} select kind, count(distinct case when expected = actual then case_id end) as n from gold group by 1")
def distinct_successes(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("kind").agg(F.count_distinct(F.when(F.col("expected") == F.col("actual"), F.col("case_id"))).alias("n"))


@query("failure_groups", f"with {GOLD}, g as (select kind, expected, actual, count(*) as n, array_to_string(list_sort(list(case_id))[1:2], ',') as examples from gold where expected <> actual group by 1, 2, 3) select * from g order by n desc, kind, expected limit 15")
def failure_groups(spark, sf_dir):
    """Largest groups of failures with two examples each."""
    wrong = gold(spark, sf_dir).where("expected <> actual")
    low = wrong.withColumn("k", F.row_number().over(Window.partitionBy("kind", "expected", "actual").orderBy("case_id")))
    out = low.groupBy("kind", "expected", "actual").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 2, F.col("case_id")))), lambda x: x.cast("string")), ",").alias("examples"))
    return out.orderBy(F.desc("n"), "kind", "expected").limit(15)


@query("hash_sample", "select doc_id, lang, rank from (select doc_id, lang, row_number() over (partition by lang order by sha256('seed' || cast(doc_id as varchar)), doc_id) as rank from documents) where rank <= 25")
def hash_sample(spark, sf_dir):
    """Twenty-five documents of each language, by hash: the quota is the operator."""
    order = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 25")


@query("holdout_split", "select doc_id, case when cast('0x' || left(sha256('split' || cast(doc_id as varchar)), 8) as bigint) < 1073741824 then 'holdout' else 'dev' end as split from documents")
def holdout_split(spark, sf_dir):
    """A quarter by hash, which needs no order of all rows."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("split"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 1 << 30, "holdout").otherwise("dev").alias("split"))


@query("status_labels", "select case role when 'user' then 'match' when 'system' then 'no match' else 'unsure' end as label, count(*) as n from conversations group by 1")
def status_labels(spark, sf_dir):
    status = F.when(F.col("role") == "user", "matched").when(F.col("role") == "system", "no-match").otherwise("needs-choice")
    return table(spark, sf_dir, "conversations").groupBy(qlog.label_of_status(status).alias("label")).agg(F.count("*").alias("n"))


FORMS = ["path", "stem", "upper", "spaced"]


@query("variation_grid", "with p(k, phrase) as (values " + ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES)) + "), n as (select fid, unnest([path, stem, upper(stem), replace(stem, '_', ' ')]) as name, unnest(['path', 'stem', 'upper', 'spaced']) as form from code_files) select fid, k, form, replace(phrase, '{}', name) as question from n, p", ("code_files",))
def variation_grid(spark, sf_dir, files=None):
    """Every phrase with every form of every file's name, made in place from literals."""
    files = code_files(spark, sf_dir) if files is None else files
    names = F.array(*[F.struct(F.lit(f).alias("form"), x.alias("name")) for f, x in zip(FORMS, [F.col("path"), F.col("stem"), F.upper("stem"), F.replace("stem", F.lit("_"), F.lit(" "))], strict=True)])
    phrases = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(p).alias("phrase")) for i, p in enumerate(PHRASES)])
    rows = files.select("fid", F.explode(names).alias("f")).select("fid", "f.form", "f.name", F.explode(phrases).alias("p"))
    return rows.select("fid", "p.k", "form", F.replace("p.phrase", F.lit("{}"), F.col("name")).alias("question"))


def parsed_grid(spark, sf_dir):
    """(k, form, op) of the whole grid. Files are few bytes and many questions, so they are dealt to all tasks before the grid is made."""
    files = code_files(spark, sf_dir).select("fid", "path", "stem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fid")
    rows = variation_grid(spark, sf_dir, files).select("k", "form", T.normalize_question(F.col("question")).alias("normal"))
    return rows.select("k", "form", T.operation(F.col("normal")).alias("op"))


@query("grid_operations", GRID + f", o as (select k, form, {duck_intent().split(', case')[0]} from q) select k, form, op, count(*) as n from o group by 1, 2, 3", ("code_files",))
def grid_operations(spark, sf_dir):
    """The whole grid parsed: questions by phrase, form and operation."""
    rows = parsed_grid(spark, sf_dir)
    return rows.groupBy("k", "form", "op").agg(F.count("*").alias("n"))


CHANGES = ("lower", "upper", "question mark", "stop", "the", "please", "file", "function", "inserted")


@query(
    "variation_perturbations",
    "with m as (select fid, stem, unnest(['lower', 'upper', 'question mark', 'stop', 'the', 'please', 'file', 'function', 'inserted']) as change from code_files) select fid, change, 'where is ' || case change when 'lower' then lower(stem) when 'upper' then upper(stem) when 'question mark' then stem || '?' when 'stop' then stem || '.' when 'the' then 'the ' || stem when 'please' then stem || ' please' when 'file' then 'file ' || stem when 'function' then 'function ' || stem else stem || 'z' end as question, false as negative from m"
    " union all select -1 - i, 'absent', 'where is ' || left(sha256('absent' || i), 12), true from range(0, 240) r(i)",
    ("code_files",),
)
def variation_perturbations(spark, sf_dir):
    """Every file asked for with one change at a time, and 240 questions for what is not there."""
    s, c = F.col("stem"), F.col("change")
    said = {"lower": F.lower(s), "upper": F.upper(s), "question mark": F.concat(s, F.lit("?")), "stop": F.concat(s, F.lit(".")), "the": F.concat(F.lit("the "), s), "please": F.concat(s, F.lit(" please")), "file": F.concat(F.lit("file "), s), "function": F.concat(F.lit("function "), s)}
    text = F.concat(s, F.lit("z"))
    for name, value in said.items():
        text = F.when(c == name, value).otherwise(text)
    rows = code_files(spark, sf_dir).select("fid", "stem", F.explode(F.array(*map(F.lit, CHANGES))).alias("change")).select("fid", "change", F.concat(F.lit("where is "), text).alias("question"), F.lit(False).alias("negative"))
    absent = spark.range(240).select((-1 - F.col("id")).alias("fid"), F.lit("absent").alias("change"), F.concat(F.lit("where is "), F.substring(F.sha2(F.concat(F.lit("absent"), F.col("id").cast("string")), 256), 1, 12)).alias("question"), F.lit(True).alias("negative"))
    return rows.unionByName(absent)


@query("log_rotation", "with e as (select event_type, event_id, octet_length(encode(props)) + 1 as n from events), f as (select event_type, list_reduce(list({'s': cast(n as bigint), 'g': [0::bigint], 'b': cast(n as bigint)} order by event_id), lambda a, x: case when a.s + x.s > 500 then {'s': x.s, 'g': list_append(a.g, a.g[-1] + 1), 'b': a.b} else {'s': a.s + x.s, 'g': list_append(a.g, a.g[-1]), 'b': a.b} end) as r from e group by 1) select event_type, len(r.g) as lines, r.g[-1] + 1 as generations, r.s as bytes from f")
def log_rotation(spark, sf_dir):
    """Logs that turn to a new generation when a line would exceed 500 bytes: how many there were, and what the last holds."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.octet_length("props") + 1).cast("long").alias("n"))
    return qlog.rotated(rows, "event_type", "event_id", "n", 500)


@query("log_order", f"with {LOG} select entry_id, n from (select entry_id, seq, row_number() over (order by case when seq % 10 = 0 then 0 else seq end desc, seq desc) as n from log where kind = 'question') where n <= 50")
def log_order(spark, sf_dir):
    """The newest fifty questions; those without a time of making count as the oldest."""
    rows = log(spark, sf_dir).where("kind = 'question'").withColumn("made", F.when(F.col("seq") % 10 != 0, F.col("seq")))
    top = rows.orderBy(F.coalesce("made", F.lit(0)).desc(), F.desc("seq")).limit(50)
    return top.withColumn("n", F.row_number().over(Window.orderBy(F.coalesce("made", F.lit(0)).desc(), F.desc("seq"))).cast("long")).select("entry_id", "n")
