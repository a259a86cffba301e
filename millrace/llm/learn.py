"""Bounded training samples, logistic regression and small decision trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
TRAIN_ROWS = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` (id and text) with `label` 0 or 1, at most `rows` ids of each class in hash order.

    The ids sampled are at most 2 * rows, so they are broadcast and `docs` isn't
    shuffled. An id that is labelled both 0 and 1 tells nothing and is left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in (0, 1)]
    return docs.join(F.broadcast(parts[0].union(parts[1])), F.col(id_col) == F.col("_id")).drop("_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-3, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient, lasso on the weights alone."""
    n, k = x.shape
    if not n or len(np.unique(y)) < 2:
        return np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
    z = np.hstack([x, np.ones((n, 1))])
    lip = (np.linalg.norm(z, 2) ** 2) / (4 * n) + l2
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        grad = z.T @ (sigmoid(z @ v) - y) / n
        grad[:-1] += l2 * v[:-1]
        to = v - grad / lip
        to[:-1] = np.sign(to[:-1]) * np.maximum(np.abs(to[:-1]) - l1 / lip, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = to + (t - 1) / s * (to - w)
        if np.abs(to - w).max() < 1e-7:
            w = to
            break
        w, t = to, s
    return w[:-1], float(w[-1])


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, try_: int, least: int = 5, cuts: int = 24):
    """A tree as nested (feature, threshold, below, above, mean) or (mean,): below is <=."""
    mean = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or mean in (0.0, 1.0):
        return (mean,)
    best = (1e-9, 0, 0.0)
    total, base = len(y), mean * (1 - mean)
    for f in rng.choice(x.shape[1], min(try_, x.shape[1]), replace=False):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1]))
        for cut in edges:
            low = x[:, f] <= cut
            n = int(low.sum())
            if n < least or total - n < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            gain = base - (n * p * (1 - p) + (total - n) * q * (1 - q)) / total
            if gain > best[0]:
                best = (gain, int(f), float(cut))
    if best[0] <= 1e-9:
        return (mean,)
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1, rng, try_, least, cuts), grow(x[~low], y[~low], depth - 1, rng, try_, least, cuts), mean)


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, try_: int, most: int = 4_000) -> list:
    """Trees on bootstrap samples of at most `most` rows."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), most)) if len(y) else np.zeros(0, int)
        out.append(grow(x[rows], y[rows], depth, rng, try_))
    return out
