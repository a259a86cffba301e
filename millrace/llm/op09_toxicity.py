"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause: insult, threat, target, negation
and reported speech. They are composed into one machine over the product of
their states; an insult or a threat emits its weight times the factors of the
state it is read in (negated, reported), and the clause's sum is raised at the
end if a target was addressed. A text is judged by its matched clauses alone:
their number, best and total score, the best score for a clause's length, threats
and insults at a target, and clauses that a negation or a report weakens.

The insult lexicon isn't given: words and word stems are mined from a bounded
labelled sample by a likelihood ratio against clean texts. Clause features are
made out of fold (each half is read with the other half's lexicon), and a
logistic regression turns them into a score.

Edge cases: null and empty texts have no clauses and get the score of a text
without matches; with labels of one class the score is their base rate; null or
other labels are not learned, nor those of an id that has both; repeated rows are
scored each; a very long text is read whole; an empty table gives an empty
result; extra columns pass through, and where one is called like a result, the
result gets underscores in front of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import labelled_sample, logistic, sigmoid
from .words import ALNUM, Words, annotate, map_texts, text_bytes

# Words of the closed classes, in English, French, German, Spanish.
TARGETS = "you your yours u ya yourself tu toi te vous ton ta votre du dich dir dein deine ihr euch usted ustedes vos vosotros"
NEGATIONS = "not no never isn aren wasn don doesn didn pas ne jamais nicht kein keine nie nunca ni"
REPORTS = "said says wrote called quoted quote claims according dit disait sagte schrieb dijo dice"
THREATS = "kill hurt destroy burn shoot stab strangle tuer tuerai frapper umbringen töten schlagen matar mataré golpear"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

STEMS = [3, 4, 5, 6]
#: Least likelihood ratio and log odds of a word or stem, and most of them.
EVIDENCE, ODDS, LEXICON = 16.0, 1.5, 20_000


def transducer(states: int, moves: dict, factors: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the next state and of the factor by state and class; a class
    without a move stays where it is."""
    to = np.tile(np.arange(states)[:, None], (1, 6))
    by = np.ones((states, 6))
    for (state, symbol), next_ in moves.items():
        to[state, symbol] = next_
    for (state, symbol), factor in factors.items():
        by[state, symbol] = factor
    return to, by


def compose(*machines: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The product machine: states multiply, factors multiply."""
    to, by = machines[0]
    for next_to, next_by in machines[1:]:
        n = len(next_to)
        to = (to[:, None, :] * n + next_to[None, :, :]).reshape(-1, 6)
        by = (by[:, None, :] * next_by[None, :, :]).reshape(-1, 6)
    return to, by


# a negation weakens what follows within three words
_NEGATION = transducer(
    4,
    {(s, NEGATION): 3 for s in range(4)} | {(s, c): s - 1 for s in (1, 2, 3) for c in (OTHER, TARGET, REPORT, INSULT, THREAT)},
    {(s, c): 0.5 for s in (1, 2, 3) for c in (INSULT, THREAT)},
)
# reported speech weakens the rest of the clause
_REPORT = transducer(2, {(0, REPORT): 1}, {(1, INSULT): 0.7, (1, THREAT): 0.7})
# an insult after an insult counts more
_INSULT = transducer(2, {(0, INSULT): 1}, {(1, INSULT): 1.25})
# a threat needs a target to count wholly
_THREAT = transducer(2, {(0, THREAT): 1}, {})
_TARGET = transducer(2, {(0, TARGET): 1}, {(1, INSULT): 1.5, (1, THREAT): 2.0})
NEXT, FACTOR = compose(_NEGATION, _REPORT, _INSULT, _THREAT, _TARGET)
THREAT_WEIGHT, LATE_TARGET = 2.0, 1.25


def read_clause(symbols: np.ndarray, weights: np.ndarray) -> tuple[float, bool, bool, bool]:
    """The clause's score, whether it holds a threat at a target, whether an insult
    at one, and whether a negation or a report weakens all that it says."""
    state, total, aimed, weak = 0, 0.0, False, True
    for symbol, weight in zip(symbols.tolist(), weights.tolist(), strict=True):
        if symbol in (INSULT, THREAT):
            factor = FACTOR[state, symbol]
            total += weight * factor
            aimed |= state % 2 == 0
            weak &= factor < 1
        state = NEXT[state, symbol]
    has_target, has_threat, has_insult = state % 2, state // 2 % 2, state // 4 % 2
    return total * (LATE_TARGET if has_target and aimed else 1.0), bool(has_target and has_threat), bool(has_target and has_insult), weak


def _hash_words(text: str) -> np.ndarray:
    raw = text.encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    return w.hashes()


_CLOSED = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}


def word_features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature hashes): the word itself, then its stems."""
    return [(np.arange(len(w.start)), w.hashes()), *w.prefix_hashes(STEMS)]


class Lexicon:
    """Weights of words and stems, by hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Weight of each hash, 0 if it isn't listed."""
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)

    def of_words(self, w: Words) -> np.ndarray:
        """The largest weight among a word's features."""
        out = np.zeros(len(w.start))
        for at, h in word_features(w):
            np.maximum.at(out, at, self.find(h))
        return out


FEATURES = 8


def clause_features(raw: np.ndarray, off: np.ndarray, lexicons: list[Lexicon], which: np.ndarray | None = None) -> np.ndarray:
    """Features of each text from its matched clauses; `which` lexicon reads which text."""
    w = Words(raw, off, ALNUM)
    out = np.zeros((w.texts, FEATURES))
    if not len(w.start):
        return out
    h = w.hashes()
    weight = lexicons[0].of_words(w)
    for i, x in enumerate(lexicons[1:], 1):
        weight = np.where(which[w.text] == i, x.of_words(w), weight)
    symbol = np.full(len(h), OTHER)
    for kind, listed in _CLOSED.items():
        symbol[np.isin(h, _hash_words(listed))] = kind
    symbol[weight > 0] = INSULT
    weight[symbol == THREAT] = THREAT_WEIGHT
    stop = np.concatenate([[0], np.cumsum(np.isin(w.bytes, [46, 33, 63, 59, 58, 10]))])
    clause = np.concatenate([[0], np.cumsum((stop[w.start[1:]] != stop[w.start[:-1]]) | (w.text[1:] != w.text[:-1]))])
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    edges = np.searchsorted(clause, np.arange(clause[-1] + 2))
    for c in np.unique(clause[hits]):
        lo, hi = edges[c], edges[c + 1]
        score, threat, insult, weak = read_clause(symbol[lo:hi], weight[lo:hi])
        x = out[w.text[lo]]
        x[0] += 1
        x[1] = max(x[1], score)
        x[2] += score
        x[3] += threat
        x[4] += insult
        x[5] = max(x[5], score / np.sqrt(hi - lo))
        x[6] += weak
    out[:, 7] = out[:, 2] / np.sqrt(np.maximum(w.count, 1))
    out[:, [0, 2, 3, 4, 6]] = np.log1p(out[:, [0, 2, 3, 4, 6]])
    return out


def _mine(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per feature: texts of each class and fold that hold it."""
    w = Words(*text_bytes(batch.column(0)), ALNUM)
    group = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()
    keys, groups = [], []
    for at, h in word_features(w):
        order = np.lexsort((h, w.text[at]))
        h, t = h[order], w.text[at][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        keys.append(h[new])
        groups.append(group[t[new]])
    key, which = np.concatenate(keys), np.concatenate(groups)
    kinds, number = np.unique(key, return_inverse=True)
    n = np.bincount(number * 4 + which, minlength=4 * len(kinds)).reshape(-1, 4).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(4))], ["h", "n0", "p0", "n1", "p1"])


def _lexicon(counts: DataFrame, p: str, n: str, pos: int, neg: int) -> Lexicon:
    """Features that toxic texts hold far oftener than clean ones."""
    share = pos / max(pos + neg, 1)
    x = counts.select("h", F.expr(p).cast("double").alias("p"), F.expr(n).cast("double").alias("n")).where("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    both = F.col("p") + F.col("n")
    ratio = 2 * (F.col("p") * F.log(F.col("p") / (both * share)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (both * (1 - share)))).otherwise(0.0))
    rows = x.select("h", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= ODDS) & (F.col("ratio") >= EVIDENCE)).orderBy(F.desc("ratio"), "h").limit(LEXICON).collect()
    return Lexicon(np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.odds for r in rows], float))


class Grammar:
    """The lexicon and the weights of clause features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """A grammar from a sample of the labelled rows (TRAIN_ROWS of each class at most).

    Copies of a text count once.
    """
    sample = labelled_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels.withColumnRenamed(id_col, "id"), label, "id")
    sample = sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"), F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"))
    sample = sample.dropDuplicates(["text", "label"]).persist()
    try:
        sizes = {(r.label, r.fold): r.n for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
        n = [[sizes.get((y, f), 0) for f in (0, 1)] for y in (0, 1)]
        if not sum(n[0]) or not sum(n[1]):
            total = sum(n[0]) + sum(n[1])
            return Grammar(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), np.zeros(FEATURES), float(np.log((sum(n[1]) + 0.5) / (sum(n[0]) + 0.5))) if total else 0.0)
        counts = map_texts(sample, _mine, "h long, n0 long, p0 long, n1 long, p1 long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1"))).where("p0 + p1 >= 3").persist()
        whole = _lexicon(counts, "p0 + p1", "n0 + n1", sum(n[1]), sum(n[0]))
        halves = [_lexicon(counts, "p1", "n1", n[1][1], n[0][1]), _lexicon(counts, "p0", "n0", n[1][0], n[0][0])]
        counts.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(halves)

        def features(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = clause_features(*text_bytes(batch.column(0)), shared.value, batch.column(2).to_numpy())
            return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(FEATURES))], ["label", *(f"f{i}" for i in range(FEATURES))])

        rows = map_texts(sample, features, "label long, " + ", ".join(f"f{i} double" for i in range(FEATURES))).collect()
    finally:
        sample.unpersist()
    x = np.array(sorted(tuple(r) for r in rows), float)
    weights, bias = logistic(x[:, 1:], x[:, 0], l2=1e-3)
    return Grammar(whole, weights, bias)


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        g = shared.value
        x = clause_features(*text_bytes(batch.column(batch.schema.names.index(text_col))), [g.lexicon])
        s = sigmoid(x @ g.weights + g.bias)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return annotate(docs, fn, {"score": "double", "predicted": "int"}, text_col)[0]
