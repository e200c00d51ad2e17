"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import bounded_sample, fold, table, with_columns

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "marks", "bangs", "bars", "stops", "commas",
    "lines", "distinct", "top_word", "echo", "above_ascii", "line_copies", "short", "long",
    "plain_ends", "capital_starts", "distinct_pairs",
)
#: Bytes of #, $, %, &, * and the like: ASCII punctuation apart from . , ! | and quotes.
MARKS = np.array([ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"])
#: Labelled rows that a fit takes at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3


def text_features(text: bytes | None) -> list[float]:
    """Surface statistics of one whole text; null is empty, and an empty text has zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in text.split(b"\n") if x]
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    starts = np.fromiter((w[0] for w in words), np.uint8, n)
    plain = ((ends | 32) >= 97) & ((ends | 32) <= 122) | (ends == 46) | (ends == 44) | (ends > 127)
    return [
        np.log1p(n), len(text) / n, upper / max(1, upper + lower), seen[48:58].sum() / n,
        seen[MARKS].sum() / n, seen[33] / n, seen[124] / n, seen[46] / n, seen[44] / n,
        len(lines) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, seen[128:].sum() / len(text),
        1 - len(set(lines)) / max(1, len(lines)), (sizes <= 3).mean(), (sizes >= 10).mean(),
        plain.mean(), ((starts >= 65) & (starts <= 90)).mean(),
        len(set(zip(words, words[1:], strict=False))) / n,
    ]


@dataclass
class AdditiveModel:
    """Log odds: intercept, a table over the bins of each feature, and one over each pair's."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[
                np.searchsorted(self.coarse[i], x[:, i], side="right"),
                np.searchsorted(self.coarse[j], x[:, j], side="right"),
            ]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain, and the bins on the left of its cut (0: no cut helps)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < 1) | (hr < 1)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """A shallow tree over the bins of one feature: the step for each bin."""
    at = _cut(g, h, ridge)[1] if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, depth - 1), _tree(g[at:], h[at:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The better of two trees over a grid: a cut of one feature, then of the other on each side."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gain, at = _cut(a.sum(1), b.sum(1), ridge)
        out = np.zeros_like(a)
        for rows in (slice(None, at), slice(at, None)) if at else (slice(None),):
            more, cut = _cut(a[rows].sum(0), b[rows].sum(0), ridge)
            gain += more
            for cols in (slice(None, cut), slice(cut, None)) if cut else (slice(None),):
                out[rows, cols] = a[rows, cols].sum() / (b[rows, cols].sum() + ridge)
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best


def train(
    x: np.ndarray, y: np.ndarray, *, bins: int = 48, rounds: int = 120, rate: float = 0.15,
    n_pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 40, ridge: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree over its bins, fitted
    to the current gradients and added to its table; then the pairs with the largest gain left
    over get theirs the same way. No rows, or one label only: the smoothed base rate."""
    rate0 = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate0 / (1 - rate0))))
    if len(np.unique(y)) < 2:
        return model
    cuts = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    f = x.shape[1]
    model.edges = [cuts(x[:, j], bins) for j in range(f)]
    model.coarse = [cuts(x[:, j], pair_bins) for j in range(f)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, at in enumerate(fine):
            g, h = slopes()
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(at, g, k), np.bincount(at, h, k), ridge)
            model.tables[j] += step
            z += step[at]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        at = rough[i] * b + rough[j]
        g, h = slopes()
        return at, tuple(np.bincount(at, v, a * b).reshape(a, b) for v in (g, h))

    gains = {(i, j): _pair_tree(*grid(i, j)[1], ridge)[0] for i, j in combinations(range(f), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            at, sums = grid(i, j)
            step = rate * _pair_tree(*sums, ridge)[1]
            t += step
            z += step.ravel()[at]
    return model


def _features(texts: Iterator[bytes | None]) -> list[list]:
    return [[text_features(t) for t in texts]]


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", folds: int = 5, sample_rows: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """Learn from labelled documents whose fold isn't 0.

    ``sample_rows`` bounds the labelled rows used: those with the smallest hash of the id. Only
    their ids are broadcast and only their statistics come to the driver. Labels other than 0 and
    1 are ignored; an id with both labels counts as 1; labels without a document and documents
    without a label aren't used; repeated documents count once.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), folds) != 0))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, id_col, sample_rows)
    docs = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    made = with_columns(
        docs, text_col, [("x", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], _features
    )
    rows = made.groupBy(id_col).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = rows.orderBy(id_col).select("x", "y").collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r.y for r in rows], dtype=np.float64))


def with_score(df: DataFrame, model: AdditiveModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of each whole text (null counts as empty)."""

    def scored(texts: Iterable[bytes | None]) -> list[list]:
        x = np.array([text_features(t) for t in texts], dtype=np.float64)
        return [model.score(x.reshape(-1, len(FEATURES)))]

    return with_columns(df, text_col, [(out, T.DoubleType(), pa.float64())], scored)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``; rows in fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
