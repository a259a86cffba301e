"""Quality classifier: a sparse rule ensemble.

Statistics of each text are computed in one vectorised pass. Trees are grown on
bootstrap samples of a bounded labelled sample; each path from a root becomes a
conjunctive rule over the statistics. A lasso logistic regression keeps few rules,
which are compiled into Spark column expressions that score every text.

Edge cases: null and empty texts have statistics 0 and are scored like any
other; with no labels of both classes the score is the base rate (0.5 without
labels); null or other labels than 0 and 1 are not learned, nor those of an id
that has both; repeated rows are scored each; a very long text is one row of
statistics like any other; an empty table gives an empty result; extra columns
pass through, and where one is called like a result, the result gets underscores
in front of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import forest, labelled_sample, logistic
from .words import NOT_SPACE, Words, annotate, fresh, text_bytes

TREES, DEPTH, SEED = 40, 3, 11
LASSO = 2e-3

STATS = ["n_bytes", "n_words", "word_len", "punct", "upper", "digit", "symbol", "pipes", "distinct_words", "repeat_next", "distinct_grams", "top_gram", "lines", "distinct_lines", "line_words", "sentence_words", "symbol_ends", "upper_words"]


def _flags(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_PUNCT, _SYMBOL = _flags(".,;:!?'\"()-"), _flags("#$%&*+/<=>@[\\]^_`{|}~")
_STOP = _flags(".!?")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its commonest comes."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])]))
    runs = np.diff(np.append(first, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, t[first], runs)
    return np.bincount(t[first], minlength=n), top


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n, size = len(off) - 1, np.diff(off).astype(float)
    w = Words(raw, off, NOT_SPACE, lower=False)
    h = w.hashes()
    words = w.count.astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return _ratio(total[off[1:]] - total[off[:-1]], size)

    def of_words(flag: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(w.text, flag, minlength=n), words)

    upper = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    caps = np.concatenate([[0], np.cumsum(upper[raw])])
    inside = caps[w.end] - caps[w.start]
    distinct, _ = _per_text(h, w.text, n)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    g, at = w.grams(3, h)
    kinds, top = _per_text(g, w.text[at], n)
    grams = np.maximum(words - 2, 0)
    not_line_end = np.ones(256, bool)
    not_line_end[10] = False
    rows = Words(raw, off, not_line_end, lower=False)
    lines = rows.count.astype(float)
    line_kinds, _ = _per_text(rows.hashes(), rows.text, n)
    ends = raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    stops = np.bincount(w.text, _STOP[ends], minlength=n)
    return np.stack(
        [
            size, words, _ratio(np.bincount(w.text, w.end - w.start, minlength=n), words), share(_PUNCT), share(upper), share(_flags("0123456789")), share(_SYMBOL), share(_flags("|")),
            _ratio(distinct, words), of_words(same), _ratio(kinds, grams), _ratio(top, grams), lines, _ratio(line_kinds, lines), _ratio(words, lines), _ratio(words, np.maximum(stops, 1)),
            of_words(_SYMBOL[ends]), of_words(inside > 1),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        x = statistics(*text_bytes(batch.column(batch.schema.names.index(text_col))))
        return [pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATS))]

    return annotate(docs, fn, dict.fromkeys(STATS, "double"), text_col)


def paths(tree, so_far: tuple = ()) -> list[tuple]:
    """Conjunctions of (feature, above, threshold) of every node below the root."""
    out = [so_far] if so_far else []
    if len(tree) > 1:
        f, cut, below, above, _ = tree
        out += paths(below, (*so_far, (f, False, cut))) + paths(above, (*so_far, (f, True, cut)))
    return out


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


class Rules:
    """Weighted rules and an intercept."""

    def __init__(self, weights: dict[tuple, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, names: dict[str, str]) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            test = F.lit(True)
            for f, above, cut in rule:
                col = F.col(names[STATS[f]])
                test = test & ((col > cut) if above else (col <= cut))
            total = total + F.when(test, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """Rules from a sample of the labelled rows of `docs` (TRAIN_ROWS of each class at most)."""
    sample = labelled_sample(docs.select(id_col, text_col), labels, label, id_col)
    stats, names = with_statistics(sample, text_col)
    rows = sorted(tuple(r) for r in stats.select("label", *names.values()).collect())
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(STATS))
    y = np.array([r[0] for r in rows], float)
    if len(np.unique(y)) < 2:
        return Rules({}, logistic(x, y)[1])
    rules = sorted({p for t in forest(x, y, TREES, DEPTH, SEED, try_=6) for p in paths(t)})
    if not rules:
        return Rules({}, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    on = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    # equal columns carry one weight
    _, keep = np.unique(on, axis=1, return_index=True)
    keep = [i for i in np.sort(keep) if 0 < on[:, i].mean() < 1]
    w, b = logistic(on[:, keep], y, l1=LASSO, l2=1e-5, steps=600)
    return Rules({rules[i]: float(v) for i, v in zip(keep, w, strict=True) if abs(v) > 1e-6}, b)


def score(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """`docs` with score and predicted, without the statistics."""
    stats, names = with_statistics(docs, text_col)
    score_, predicted = fresh("score", docs.columns), fresh("predicted", docs.columns)
    out = stats.select(*docs.columns, rules.score(names).alias(score_))
    return out.withColumn(predicted, (F.col(score_) >= 0.5).cast("int"))
