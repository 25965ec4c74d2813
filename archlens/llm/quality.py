"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are counts over its whole length, so they need one pass and constant memory beside the text. Trees
are grown on the driver from a bounded sample of labelled rows, by gradient sums over at most ``BINS`` bins of each
statistic. A fitted model is four arrays, (tree, node) -> feature, threshold, children, value, and is traversed for a whole
batch at once, one level after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import held_out, sliced, training_rows

#: Labelled rows that are learned from at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 80, 4, 0.12, 64, 8, 2.0
STATISTICS = (
    "words", "characters", "mean_word", "longest_word", "distinct_words", "top_word", "top_three_words", "repeated_next", "lines", "mean_line",
    "repeated_lines", "one_word_lines", "upper", "digits", "punctuation", "symbols", "bars", "exclamations", "white", "non_ascii", "stops", "commas",
    "capital_words", "short_words", "long_words", "odd_ends",
)

_UPPER, _DIGIT, _SYMBOL, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]|\\/=+_", b".,;:!?'\"()-"


def _table(chars: bytes):
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all 0 for a null or empty one."""
    from collections import Counter

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda chars: float(hist[list(chars)].sum()) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct_lines = Counter(lines)
    last = hist_of_last(words)
    return [
        float(np.log1p(n)), float(np.log1p(size)), size / n, float(np.log1p(lengths.max())), len(seen) / n ** 0.8, top[0] / n, sum(top) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, float(np.log1p(len(lines))), n / len(lines),
        1 - len(distinct_lines) / len(lines), sum(1 for x in lines if b" " not in x.strip()) / len(lines), of(_UPPER), of(_DIGIT), of(_PUNCT), of(_SYMBOL), of(b"|"), of(b"!"),
        of(b" \t\n\r"), float(hist[128:].sum()) / size, of(b"."), of(b","),
        sum(1 for w in words if w[0] in _UPPER) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()), last,
    ]


def hist_of_last(words: list[bytes]) -> float:
    """The share of words that end in a sign which rarely ends one."""
    return sum(1 for w in words if w[-1] in _SYMBOL or w[-2:] == b"!!") / len(words)


@dataclass
class Trees:
    """Trees as arrays of shape (trees, nodes); a leaf is its own child."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                go = x[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(go, self.left[t, at], self.right[t, at])
            total += self.value[t, at]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; splits by gradient and curvature sums over bins."""
    n, f = x.shape
    nodes = 2 ** (DEPTH + 1) - 1
    empty = lambda dtype: np.zeros((TREES, nodes), dtype)
    own = np.tile(np.arange(nodes), (TREES, 1))
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    model = Trees(float(np.log(share / (1 - share))), empty(np.int64), empty(float), own.copy(), own.copy(), empty(float))
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    offset = binned + np.arange(f) * BINS
    raw = np.full(n, model.start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * LEAF:
                    continue
                flat = offset[rows].ravel()
                sums = [np.bincount(flat, np.repeat(w[rows], f), f * BINS).reshape(f, BINS).cumsum(axis=1) for w in (grad, curve)]
                many = np.bincount(flat, minlength=f * BINS).reshape(f, BINS).cumsum(axis=1)
                (g, h), all_g, all_h = sums, grad[rows].sum(), curve[rows].sum()
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(many < LEAF) | (len(rows) - many < LEAF)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                model.feature[t, node], model.threshold[t, node] = j, edges[j][b]
                model.left[t, node], model.right[t, node] = 2 * node + 1, 2 * node + 2
                at[rows] = np.where(binned[rows, j] <= b, 2 * node + 1, 2 * node + 2)
        for node in np.unique(at):
            rows = at == node
            model.value[t, node] = RATE * grad[rows].sum() / (curve[rows].sum() + RIDGE)
        raw += model.value[t, at]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns from at most ``sample`` labelled rows, of which only statistics reach the driver."""

    def told(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in sliced(batches):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": x}, schema=schema)

    rows = training_rows(docs, labels, "quality", sample).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    got = rows.mapInArrow(told, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return grow(x, got["y"].to_numpy(float))


def judged(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc, score): each row of docs as a struct, whatever its columns are called, beside its score."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.predict(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.withColumn("score", F.pandas_udf(score, "double")(F.col("doc.text").cast("string")))


def scores(docs: DataFrame, model: Trees, score: str = "quality_score") -> DataFrame:
    """docs with a column ``score`` (0 to 1), by whole texts; a column of docs that is called so gives way."""
    return judged(docs, model).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != score], F.col("score").alias(score))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...); labels(doc_id, quality, ...).

    Every row gets a score, null and empty texts too; predicted is 1 from 0.3. Repeated rows score alike. A null
    doc_id is not held out. Without usable labels every score is the same, 0.5. An empty table gives an empty result; further
    columns are ignored.
    """
    rows = judged(docs.select("doc_id", "text"), fit(docs, labels, sample)).select("doc.doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
