"""Queries of evaluation: outcomes of the scorer on texts whose answers are known, with and without learned aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.operators import graph, outcomes, scoring
from archlens.plans.base import query
from archlens.plans.scoring import HEADS, LEARNED_SQL, SCORER, TEXTS, VIEWS, finish_sql, learned, prepared, prior
from archlens.sources.tables import code_files, seeds

#: What each text of the scorer should come to, and the field that holds its target.
EXPECTED = (
    ("match", "path"), ("match", "path"), ("match", "path"), ("choose", "path"), ("match", "path"), ("choose", "path"), ("choose", "path"), ("no-match", None), ("no-match", None), ("match", "top"), ("match", "top"), ("match", "top"),
    ("choose", "top"), ("no-match", None), ("match", "top"), ("choose", "top"), ("match", "top"), ("choose", None), ("match", "top"), ("match", "folder"), ("choose", "folder"), ("choose", "folder"), ("choose", "path"), ("choose", "path"), ("choose", "top"), ("no-match", None),
)
assert len(EXPECTED) == len(TEXTS)
_when = lambda f: " ".join(f"when {i} then {f(e, t)}" for i, (e, t) in enumerate(EXPECTED))
_target = {None: "null", "path": "path", "top": "top", "folder": "'folder-' || left(sha256(folder), 16)"}
CASES = f"""cases as (select qid * 100 + k as qid, case k {_when(lambda e, t: f"'{e}'")} end as expected, case k {_when(lambda e, t: _target[t])} end as target,
  case when left(sha256((qid * 100 + k)::varchar), 1) < '4' then 'holdout' else 'dev' end as split, k from seeds join code_files using (path), (select unnest(range(0, {len(TEXTS)})) as k))"""
NO_ALIAS = SCORER.replace(LEARNED_SQL, "learned(alias, node) as (select 'x' as alias, 'x' as node where false)")
JUDGED = """select c.*, said, coalesce(place, 0) as place, case when case expected when 'match' then yes and place = 1 when 'choose' then said = 'choose' and place > 0 else said = 'no-match' end then 'correct' when yes then 'wrong'
    when said = 'choose' and place > 0 and expected = 'match' then 'choice' else 'lost' end as outcome
  from (select c.*, yes, case when yes then 'match' when n_suggestions > 0 then 'choose' else 'no-match' end as said, case when yes then case when choice = target then 1 else 0 end else coalesce(list_position(string_split(suggestions, ','), target), 0) end as place from cases c join {0} using (qid)) c"""
WITH = f"{CASES}, on_ as materialized ({SCORER} {finish_sql('scored', 'fin')} {HEADS.format('fin')}), with_ as ({JUDGED.format('on_')})"
WITHOUT = f"off_ as materialized ({NO_ALIAS} {finish_sql('scored', 'fin')} {HEADS.format('fin')}), without_ as ({JUDGED.format('off_')})"


def cases(spark, sf_dir):
    """(qid, expected, target, split, k): a case for each text that the scorer is asked for."""
    folder = F.concat(F.lit("folder-"), F.substring(F.sha2("folder", 256), 1, 16))
    values = {"path": F.col("path"), "top": F.col("top"), "folder": folder, None: F.lit(None).cast("string")}
    every = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(e).alias("expected"), values[t].alias("target")) for i, (e, t) in enumerate(EXPECTED)])
    rows = seeds(spark, sf_dir).join(code_files(spark, sf_dir), "path").select("qid", F.explode(every).alias("c"))
    rows = rows.select((F.col("qid") * 100 + F.col("c.k")).alias("qid"), "c.expected", "c.target", "c.k")
    return rows.withColumn("split", F.when(F.substring(F.sha2(F.col("qid").cast("string"), 256), 1, 1) < "4", "holdout").otherwise("dev"))


def run(spark, sf_dir, *modes: bool):
    """Judged cases for each mode: with learned aliases, or without."""
    t, index = prepared(spark, sf_dir)
    told, weights = graph.cut(cases(spark, sf_dir)), graph.cut(prior(spark, sf_dir))
    out = []
    for on in modes:
        ranked = graph.cut(scoring.finished(scoring.rank_literal(t, index, learned(spark) if on else None, weights)))
        out.append(graph.cut(outcomes.judged(told, scoring.heads(t, ranked))))
    return out


@query("eval_topk", f"with {WITH} select split, expected, count(*) as n, count(*) filter (place = 1) as top1, count(*) filter (place between 1 and 3) as top3, count(*) filter (said <> 'match') as abstained, count(*) filter (said = 'match' and expected = 'no-match') as false_accepts from with_ group by 1, 2", VIEWS)
def eval_topk(spark, sf_dir):
    """Targets among the first one and three, abstentions and false acceptances of the scorer, by split and by what was expected."""
    return outcomes.accuracy(run(spark, sf_dir, True)[0], "split", "expected")


@query(
    "lookup_eval",
    f"with {WITH} select k, count(*) as n, count(*) filter (said = expected) as label_right, count(*) filter (outcome = 'wrong') as accepted_wrong, count(*) filter (expected = 'choose') as choices, count(*) filter (expected = 'choose' and said = 'choose' and place > 0) as suggested from with_ group by 1",
    VIEWS,
)
def lookup_eval(spark, sf_dir):
    """Match, choice or nothing against what is expected, by kind of text."""
    return outcomes.lookups(run(spark, sf_dir, True)[0], "k")


@query(
    "eval_modes",
    f"with {WITH}, {WITHOUT}, every as (select 'alias-on' as mode, * from with_ union all select 'alias-off', * from without_) select mode, split, expected, count(*) as n, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'wrong') as wrong from every group by grouping sets ((mode, split, expected), (mode, split), (mode))",
    VIEWS,
)
def eval_modes(spark, sf_dir):
    """Outcomes with and without learned aliases, by split and by what was expected."""
    on, off = run(spark, sf_dir, True, False)
    rows = on.withColumn("mode", F.lit("alias-on")).unionByName(off.withColumn("mode", F.lit("alias-off")))
    sets = [["mode", "split", "expected"], ["mode", "split"], ["mode"]]
    return rows.groupingSets(sets, "mode", "split", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "correct").alias("correct"), F.count_if(F.col("outcome") == "wrong").alias("wrong"))


@query("transition_counts", f"with {WITH}, {WITHOUT} select b.outcome as before, a.outcome as after, count(*) as n from without_ b join with_ a using (qid) group by 1, 2", VIEWS)
def transition_counts(spark, sf_dir):
    """Cases by outcome without learned aliases and with them."""
    on, off = run(spark, sf_dir, True, False)
    return outcomes.transitions(off, on)
