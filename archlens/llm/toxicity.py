"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded texts.

The lexicon is learned: patterns are whole words and beginnings of words; a pattern's weight is the log odds
of its document frequency in toxic and other training texts less one standard error, so rare patterns weigh little.
Exception phrases are learned too: two neighbouring words, one of which a pattern matches, that other texts hold no less often than
toxic ones. Each word of a text counts with the heaviest pattern that matches it, unless it lies in an exception phrase. The sum is
set against the text's length by a logistic function of four numbers that is fitted to the same bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import held_out, sliced, training_rows
from archlens.llm.folding import fold

#: Labelled rows that are learned from at most: they bound the lexicon too. The least weight of a pattern.
SAMPLE, LEAST = 20_000, 2.5
#: Lengths of beginnings of words that are tried.
SHORTEST, LONGEST = 4, 10


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, ...]


def patterns_of(folded: str) -> set[str]:
    """Patterns of a folded text: `` word `` for a whole word, `` wor`` for a beginning."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in range(SHORTEST, min(len(w), LONGEST + 1)):
            out.add(f" {w[:n]}")
    return out


def phrases_of(folded: str, hit: set[int]) -> set[str]:
    """Pairs of neighbouring words of which one begins at a place in ``hit``, as exception phrases are written."""
    words, at, out = folded.split(), 0, set()
    places = []
    for w in words:
        places.append(at)
        at += len(w) + 1
    for i, (a, b) in enumerate(zip(words, words[1:])):
        if places[i] in hit or places[i + 1] in hit:
            out.add(f" {a} {b} ")
    return out


def matcher(model: Model):
    """folded text -> ({place: weight} of the words that count, words)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p, w in model.lexicon.items():
        machine.add_word(p, (len(p), w))
    for p in model.exceptions:
        machine.add_word(p, (len(p), None))
    if len(machine):
        machine.make_automaton()

    def match(folded: str) -> tuple[dict[int, float], int]:
        words = folded.count(" ") - 1
        best: dict[int, float] = {}
        spans = []
        for end, (n, w) in machine.iter(folded) if len(machine) else ():
            at = end - n + 1
            if w is None:
                spans.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        inside = {x for lo, hi in spans for x in range(lo, hi)}
        return {at: w for at, w in best.items() if at not in inside} if inside else best, words

    return match


def features(total: float, words: int) -> list[float]:
    import math

    return [1.0, math.log1p(total), total / math.sqrt(words + 25), 100 * total / (words + 50), math.log1p(words)]


def weight(toxic: int, other: int, n1: int, n0: int) -> float:
    """Log odds of a document frequency in toxic and other texts, less one standard error."""
    import math

    return math.log((toxic + 0.5) / (n1 + 1)) - math.log((other + 0.5) / (n0 + 1)) - math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def _frequencies(rows: DataFrame, found) -> DataFrame:
    """(p, toxic, other): of each string that found(folded) yields the numbers of toxic and other texts."""

    def seen(batches):
        from collections import Counter

        import pyarrow as pa

        schema = pa.schema([("p", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
        toxic, other = Counter(), Counter()
        for batch in sliced(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (toxic if y else other).update(found(fold(text or "")))
        every = list(toxic | other)
        yield pa.RecordBatch.from_pydict({"p": every, "toxic": [toxic[p] for p in every], "other": [other[p] for p in every]}, schema=schema)

    parts = rows.select("text", "y").mapInArrow(seen, "p string, toxic long, other long")
    return parts.groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows. Without toxic and other rows among them every text scores low."""
    import math

    # Read several times below: kept, for the sample is bounded.
    rows = training_rows(docs, labels, "toxic", sample).select("text", F.col("y").cast("int").alias("y")).persist()
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n1 or not n0:
        rows.unpersist()
        return Model({}, (), (-3.0, 0.0, 0.0, 0.0, 0.0))

    # Only patterns heavy enough reach the driver: words that the sample's toxic texts have and others hardly.
    least = max(3, math.ceil(n1 / 250))
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    heavy = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - F.sqrt(1 / a + 1 / b) >= LEAST - 1e-6
    common = _frequencies(rows, patterns_of).where(F.col("toxic") >= least).where(heavy).collect()
    weighed = {r["p"]: weight(r["toxic"], r["other"], n1, n0) for r in common}
    lexicon = {p: round(w, 4) for p, w in sorted(weighed.items()) if w >= LEAST}
    plain = Model(lexicon, (), ())

    def near_hits():
        match = matcher(plain)
        return lambda folded: phrases_of(folded, set(match(folded)[0]))

    made: list = []

    def near(folded):
        if not made:
            made.append(near_hits())
        return made[0](folded)

    # A phrase is harmless that at least three other texts hold, at a rate no less than toxic ones.
    harmless = _frequencies(rows, near).where((F.col("other") >= 3) & (F.col("other") * n1 >= F.col("toxic") * n0)).select("p").collect()
    model = Model(lexicon, tuple(sorted(r["p"] for r in harmless)), ())

    def counted(batches):
        import pyarrow as pa

        match = matcher(model)
        schema = pa.schema([("y", pa.int32()), ("total", pa.float64()), ("words", pa.int64())])
        for batch in sliced(batches):
            met = [match(fold(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "total": [math.fsum(m.values()) for m, _ in met], "words": [w for _, w in met]}, schema=schema)

    told = sorted(rows.mapInArrow(counted, "y int, total double, words long").collect())
    rows.unpersist()
    return Model(lexicon, model.exceptions, logistic([features(r["total"], r["words"]) for r in told], [r["y"] for r in told]))


def judge(text: str | None, model: Model, match) -> tuple[float, int]:
    """(score, words that count) of a whole text."""
    import math

    found, words = match(fold(text or ""))
    z = sum(a * b for a, b in zip(model.weights, features(math.fsum(found.values()), words), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found)


def logistic(x: list[list[float]], y: list[int], ridge: float = 0.5) -> tuple[float, ...]:
    """Weights of a logistic regression, by Newton's method with a ridge on all but the first."""
    import numpy as np

    x, y = np.array(x), np.array(y, float)
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z = x / scale
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), z.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def scores(docs: DataFrame, model: Model, score: str = "toxic_score", hits: str = "toxic_hits") -> DataFrame:
    """docs with columns ``score`` (0 to 1) and ``hits``, by whole texts; columns of docs that are called so give way.

    A null or empty text has no hits.
    """
    return judged(docs, model).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in (score, hits)], F.col("judged.score").alias(score), F.col("judged.hits").alias(hits))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, judged): each row of docs as a struct, whatever its columns are called, beside its score and hits."""
    import pandas as pd

    def score(batches):
        match = matcher(model)
        for texts in batches:
            yield pd.DataFrame([judge(t, model, match) for t in texts], columns=["score", "hits"])

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.withColumn("judged", F.pandas_udf(score, "score double, hits long")(F.col("doc.text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for each row of docs(doc_id, text, ...); labels(doc_id, toxic, ...).

    Every row gets a score, null and empty texts too; predicted is 1 from 0.5. Repeated rows score alike. A null
    doc_id is not held out. Labels that are null, unknown or contradictory are taken as `common.training_rows` says;
    without usable labels all scores are low. An empty table gives an empty result; further columns are ignored.
    """
    rows = judged(docs.select("doc_id", "text"), fit(docs, labels, sample)).select("doc.doc_id", "judged.score", "judged.hits")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
