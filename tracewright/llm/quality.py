"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting goes round the features; each step fits a tree of few leaves on one binned feature (then on one pair of coarsely
binned features) to the residuals and adds it to that feature's lookup table. A score is the intercept plus one table entry a
feature and pair, through the logistic function: vectorised bin additions.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_columns, named, prepare

#: Labelled rows that the model is fitted on, at most; those of the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 300, 120, 0.08, 4
FEATURES = (
    "chars", "words", "word_chars", "upper", "digits", "bang", "pipe", "signs", "other_marks", "wide", "distinct", "distinct_root",
    "repeats", "caps_words", "single_chars", "longest_word", "lines", "line_words", "repeated_lines", "odd_lines", "worst_line", "longest_run", "sentence_ends", "blanks",
)  # fixed order
SIGN_RUN = re.compile(r"[#*%&@^~$|!?=<>]{2,}|[|]")


def _share(table: np.ndarray, chars: bytes) -> float:
    return float(table[list(chars)].sum())


def features(text: str) -> list[float]:
    """The model's inputs, from the text alone; an empty text gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n, size, counts = len(words), len(raw), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = float(counts[65:91].sum()), float(counts[97:123].sum())
    distinct = len(set(words))
    same = list(map(operator.eq, words, words[1:]))
    run = longest = 0
    if True in same:
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    lines = [x for x in text.split("\n") if x.strip()]
    odd = 0.0
    worst = 0.0
    for line in lines:
        marks = len(SIGN_RUN.findall(line))
        parts = line.count(" ") + 1
        strange = max(marks / parts, float(line.isupper() and parts > 3))
        odd += strange > 0.3
        worst = max(worst, strange)
    return [
        np.log1p(len(text)), np.log1p(n), (len(text) - n + 1) / n, upper / (upper + lower + 1), counts[48:58].sum() / size, counts[33] / n, counts[124] / n,
        _share(counts, b"#*%&@^~$=<>+") / n, _share(counts, b".,;:?'\"()-_/") / n, counts[128:].sum() / size, distinct / n, distinct / np.sqrt(n),
        sum(same) / n, sum(map(str.isupper, words)) / n, sum(len(w) == 1 for w in words) / n, max(map(len, words)), np.log1p(len(lines)), n / len(lines),
        1 - len(set(lines)) / len(lines), odd / len(lines), worst, longest, counts[46] / n, (size - sum(map(len, words))) / size,
    ]


@dataclass
class Additive:
    """edges, tables: of each feature; pairs: feature numbers, coarse edges and table of each pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree of so many leaves over ordered bins, from the bins' sums of gradients and curvatures."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, b), int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return step


def _split_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of four leaves over a grid: the best cut of the one axis, and of the other axis in each part. Step and gain."""
    best = (np.zeros_like(g), 0.0)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            step, gain = np.zeros_like(gg), -gg.sum() ** 2 / (hh.sum() + 1.0)
            for rows in (slice(0, cut), slice(cut, None)):
                part = _tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), 2)
                step[rows] = part
                for v in np.unique(part):
                    where = part == v
                    gain += gg[rows][:, where].sum() ** 2 / (hh[rows][:, where].sum() + 1.0)
            if gain > best[1]:
                best = (step.T if turned else step, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits rows x to labels y (0 or 1). With no rows scores are 0.5; with one label only they are constant."""
    width = len(FEATURES)
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(rate / (1 - rate)))
    edges = [_edges(x[:, j], BINS) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if y.min() == y.max():
        return Additive(intercept, edges, tables, [])
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            if len(tables[j]) > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(binned[j], g, len(tables[j])), np.bincount(binned[j], h, len(tables[j])), LEAVES)
                tables[j] += step
                total += step[binned[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m, n = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * n + cells[j], v, m * n).reshape(m, n)

    ranked = sorted(((_split_pair(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(width) for j in range(i) if len(coarse[i]) and len(coarse[j])), reverse=True)
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            g, h = slopes()
            step = RATE * _split_pair(grid(i, j, g), grid(i, j, h))[0]
            table += step
            total += step[cells[i], cells[j]]
    return Additive(intercept, edges, tables, pairs)


def _features_udf():
    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return text.map(features)

    return of


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Additive:
    """Fits labels (doc_id, quality) to the texts of docs on `rows` labelled rows at most: those of the smallest hashes of doc_id.

    Rows with a null id or a label other than 0 and 1 teach nothing; an id labelled twice counts by its greater label.
    """
    prepare(docs.sparkSession)
    labelled = labels.select(named("doc_id").alias("__id"), named("quality").alias("__label")).filter("__id is not null and __label in (0, 1)")
    sample = labelled.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(named("doc_id").alias("__doc"), F.coalesce(named("text"), F.lit("")).alias("__text"))
    met = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id"))  # at most `rows` short rows
    got = met.select("__id", _features_udf()("__text").alias("x"), "__label").toPandas().sort_values("__id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    # equal scores for equal inputs whatever the rows' order
    order = np.lexsort((*x.T, got["__label"].to_numpy()))
    return fit(x[order], got["__label"].to_numpy(dtype=np.float64)[order])


def score(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0), which replace columns of those names.

    A null text scores as an empty one. Null and repeated doc_id values are rows like others; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    made = docs.select(*keep_columns(docs, ("score", "predicted")), scored(F.coalesce(named("text"), F.lit(""))).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
