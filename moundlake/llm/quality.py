"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.llm.common import clean_texts, crc_bucket, cut_lineage, in_batches, label_sample

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "stops", "breaks", "other_letters",
    "marked_words", "repeats", "distinct", "top_word",
)
# Bytes that prose uses rarely.
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def features(text: bytes) -> list[float]:
    """Of a whole text, in the order of FEATURES; all are shares or means, apart from the size. An empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(by[65:91].sum()), int(by[97:123].sum())
    counted = Counter(words)
    marks = SYMBOLS + b"!"
    return [
        float(np.log1p(n)), (size - n) / n, upper / max(upper + lower, 1), int(by[48:58].sum()) / size,
        int(by[list(SYMBOLS)].sum()) / size, int(by[33]) / n, int(by[124]) / n, int(by[46]) / n, int(by[10]) / n, int(by[128:].sum()) / size,
        sum(c for w, c in counted.items() if w[-1] in marks) / n,
        sum(map(eq, words, words[1:])) / n, len(counted) / n, max(counted.values()) / n,
    ]


@dataclass
class Additive:
    """A score per bin for every feature and for some pairs of features; their sum is a log-odds."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (i, j), table in self.pairs.items():
            total += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Step per bin of the tree over one feature that splits greedily into at most ``leaves`` runs of bins."""
    g, h = np.append(0, grad.cumsum()), np.append(0, hess.cumsum())
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    runs = [(0, len(grad))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for a, b in runs:
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(won.argmax())
                best = max(best, (float(won[k]), (a, b), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        (a, b), at = best[1], best[2]
        runs.remove((a, b))
        runs += [(a, at), (at, b)]
    step = np.zeros(len(grad))
    for a, b in runs:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and step per cell of the tree that cuts each of two features once."""
    corner = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = corner(grad), corner(hess)
    m, n = grad.shape
    if m < 2 or n < 2:
        return 0.0, np.zeros_like(grad)
    i, j = np.meshgrid(np.arange(1, m), np.arange(1, n), indexing="ij")
    part = lambda s: (s[i, j], s[i, n] - s[i, j], s[m, j] - s[i, j], s[m, n] - s[i, n] - s[m, j] + s[i, j])
    gain = sum(a**2 / (b + ridge) for a, b in zip(part(g), part(h), strict=True))
    k = np.unravel_index(gain.argmax(), gain.shape)
    steps = [a[k] / (b[k] + ridge) for a, b in zip(part(g), part(h), strict=True)]
    table, (ci, cj) = np.empty_like(grad), (k[0] + 1, k[1] + 1)
    table[:ci, :cj], table[:ci, cj:], table[ci:, :cj], table[ci:, cj:] = steps
    return float(gain[k]), table


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 6, bins: int = 48, pair_bins: int = 10,
    rate: float = 0.15, leaves: int = 4, ridge: float = 1.0,
) -> Additive:
    """Boost the features in turn, one shallow tree each a round; then the pairs that explain most of what is left."""
    model = Additive()
    if not len(y) or y.min() == y.max():
        model.base = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), model.base)
    model.edges = [cut_points(x[:, f], bins) for f in range(x.shape[1])]
    model.coarse = [cut_points(x[:, f], pair_bins) for f in range(x.shape[1])]
    placed = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(rounds):
        for f, at in enumerate(placed):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), leaves, ridge)
            model.tables[f] += step
            total += step[at]
    rough = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(x.shape[1])]

    def cells(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        at = rough[i] * shape[1] + rough[j]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((-quadrants(*cells(i, j, p), ridge)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    for _, i, j in gains[:pairs]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * quadrants(*cells(i, j, p), ridge)[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)`` of whole texts."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "x": [features(t) for t in batch.column("text").to_pylist()]}

    rows = clean_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return in_batches(rows, work, "doc_id long, x array<double>")


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held_out_fold: int = 0, threshold: float = 0.3, max_labels: int = 50_000,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    The model learns from about ``max_labels`` labelled documents at most (its only bound), never
    from those whose ``crc32(id) mod folds`` is ``held_out_fold``; the sample goes to the driver as 14
    numbers a document. Features come from the text alone and are made once for all rows; scoring
    adds the table entries of a row's bins, for whole Arrow batches at once.

    Defined cases: null and empty texts have all features 0 and are scored like any other; without
    labels, or with one class only, all scores are the same; null ids are scored and never
    train; rows come back as often as they went in; an empty table gives no rows.
    """
    ready = cut_lineage(text_features(docs, id_col, text_col))
    sample = label_sample(labels, label_col, id_col, lambda i: crc_bucket(i, folds) != held_out_fold, max_labels)
    taught = ready.join(F.broadcast(sample), "doc_id").select("x", "label").toArrow()  # at most about max_labels rows
    x = taught.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    model = fit(x, taught.column("label").to_numpy().astype(float))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        yield {"doc_id": batch.column("doc_id"), "score": model.score(rows)}

    scored = in_batches(ready, work, "doc_id long, score double")
    return scored.select(
        "doc_id", (crc_bucket("doc_id", folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
