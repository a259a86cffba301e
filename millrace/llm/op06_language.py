"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
against it into phrases, each the longest match from where the last one ended;
the fewer phrases, the better the language's text predicts it. Phrases are
normalised to bits a byte, ``phrases * log2(training length) / length``, and the
language that needs fewest wins (ties: the smaller name).

The parse follows the automaton's own transitions only, so that it is one table
look-up a byte, done for all segments of a chunk of texts at once. Segments of
`SEGMENT` bytes are parsed as if a phrase began at each; then every segment is
parsed again from the state in which the one before ended, until the two parses
meet in one state, which they do after a phrase or so. So phrases cross the
segments' borders, and a text is parsed whole.

Training is on a bounded sample of labelled rows: the `LANGUAGES` commonest
languages, and of each at most `TRAIN_DOCS` different texts in the order of a hash
of id and text, those of up to `TRAIN_CHARS` characters before longer ones, until
`TRAIN_BYTES` bytes are full. Texts are learned whole; only where a language's
first text alone is longer is it cut there.

Edge cases: a null text or one without a letter gives ``und`` and score 0; with
no language learned all are ``und``; null ids are an id like another; repeated
rows count once in training and are judged each; a very long text is parsed whole,
in chunks' memory; an empty table gives an empty result; extra columns pass
through, and where one is called like a result, the result gets underscores in
front of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import LOWER, annotate, fresh, text_bytes

LANGUAGES = 400
TRAIN_DOCS = 200
TRAIN_CHARS = 2_000
TRAIN_BYTES = 20_000
SEGMENT = 512
#: Bytes whose worth of evidence the score is for.
EVIDENCE = 64


def fold(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, letters kept, each run of anything else one space; new offsets."""
    b = LOWER[raw]
    latin = np.zeros(len(b), bool)
    latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    b = np.where(latin, b + 0x20, b).astype(np.uint8)
    letter = ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    b = np.where(letter, b, 0x20).astype(np.uint8)
    total = np.concatenate([[0], np.cumsum(keep)])
    return b[keep], total[off]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings of `text`."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def parse_table(text: bytes, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Next state by state and byte class; the low bit tells that a phrase began.

    The last class is padding, which changes nothing.
    """
    go = suffix_automaton(text)
    # a phrase begins in the last state, which unknown bytes lead back to
    begin = len(go)
    root = np.full(n_classes, begin, np.int64)
    for c, t in go[0].items():
        root[classes[c]] = t
    table = np.tile(root * 2 + 1, (begin + 1, 1))
    for s, edges in enumerate(go):
        for c, t in edges.items():
            table[s, classes[c]] = t * 2
    table[:, -1] = np.arange(begin + 1) * 2
    return table.astype(np.uint16 if begin < (1 << 15) - 1 else np.int32).reshape(-1)


class Parser:
    """Tables of all languages."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        used = sorted({b for t in texts.values() for b in t})
        self.classes = np.full(256, len(used), np.int64)  # one class for bytes never seen
        for i, b in enumerate(used):
            self.classes[b] = i
        self.n_classes = len(used) + 2
        self.tables = [parse_table(texts[x], self.classes, self.n_classes) for x in self.langs]
        self.weight = np.array([np.log2(max(len(texts[x]), 2)) for x in self.langs])

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits a byte of each text (rows) in each language; 0 for empty texts."""
        b, off = fold(raw, off)
        size = np.diff(off)
        n = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), n)
        at = off[:-1][owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        end = np.minimum(at + SEGMENT, off[1:][owner])
        # by length, so that the columns still open are always the first ones
        order = np.argsort(at - end, kind="stable")
        at, end, owner = at[order], end[order], owner[order]
        length = end - at
        cls = np.append(self.classes[b], self.n_classes - 1).astype(np.int32)
        out = np.zeros((len(size), len(self.langs)))
        after = np.full(len(at), -1)  # the segment that goes on with the text
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        goes_on = np.flatnonzero(np.repeat(np.cumsum(n), n) - 1 > np.arange(n.sum()))
        after[place[goes_on]] = place[goes_on + 1]
        base = np.concatenate([[0], np.cumsum(length)])
        for x, table in enumerate(self.tables):
            found = self._parse(table, cls, at, length, base, after)
            out[:, x] = np.bincount(owner, found, minlength=len(size)) * self.weight[x] / np.maximum(size, 1)
        return out

    def _parse(self, table: np.ndarray, cls: np.ndarray, at: np.ndarray, length: np.ndarray, base: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that begin in each segment; segments come longest first."""
        start = len(table) // self.n_classes - 1
        state = np.full(len(at), start, np.int32)
        found = np.zeros(len(at), np.int64)
        trace = np.empty(base[-1], np.int32)  # state and phrase by segment and step
        for step in range(int(length.max(initial=0))):
            open_ = int(np.searchsorted(-length, -step, side="left"))
            to = table[state[:open_] * self.n_classes + cls[at[:open_] + step]].astype(np.int32)
            trace[base[:open_] + step] = to
            found[:open_] += to & 1
            state[:open_] = to >> 1
        # from the state in which the segment before ended, until both parses are in one state
        todo = np.flatnonzero(after >= 0)
        now, enters = after[todo], state[todo]
        while len(now):
            step, left, changed = 0, np.arange(len(now)), []
            cur = enters.copy()
            while len(left):
                seg = now[left]
                ended = step >= length[seg]
                if ended.any():
                    changed.append(left[ended])
                    left, seg = left[~ended], seg[~ended]
                    if not len(left):
                        break
                to = table[cur[left] * self.n_classes + cls[at[seg] + step]].astype(np.int32)
                had = trace[base[seg] + step]
                found[seg] += (to & 1) - (had & 1)
                trace[base[seg] + step] = to
                cur[left] = to >> 1
                left = left[(to >> 1) != (had >> 1)]
                step += 1
            # a segment that never met ends in another state, which the next one begins in
            moved = np.concatenate(changed) if changed else np.zeros(0, np.int64)
            moved = moved[after[now[moved]] >= 0]
            now, enters = after[now[moved]], cur[moved]
        return found


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Automata from `docs`, all of whose rows with a language may be learned from.

    What comes to the driver is at most LANGUAGES * TRAIN_DOCS hashes, and then texts
    of TRAIN_BYTES bytes (or one text) for each language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    order = F.struct((F.length(text_col) > TRAIN_CHARS).alias("long"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    known = known.select(F.col(lang_col).alias("lang"), order.alias("o"), F.octet_length(text_col).alias("n"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    different = [F.approx_count_distinct(F.when(F.col("o.long") == long, F.col("o.h"))).alias(f"n{int(long)}") for long in (False, True)]
    common = known.groupBy("lang").agg(F.count("*").alias("rows"), *different).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not common:
        return Parser({})
    # by a bound on the hash some more rows come than are needed, however many a language has
    bounds = [(r.lang, long, min(1.0, 4.0 * TRAIN_DOCS / max(n, 1))) for r in common for long, n in ((False, r.n0), (True, r.n1))]
    bounds = F.broadcast(spark.createDataFrame(bounds, "lang string, long boolean, bound double"))
    known = known.withColumn("long", F.col("o.long")).join(bounds, ["lang", "long"]).where(F.pmod("o.h", F.lit(1 << 32)) < F.col("bound") * float(1 << 32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o"))
    first = known.groupBy("lang", "o").agg(F.first("n").alias("n"))
    wanted: dict[str, list] = {}
    for r in first.withColumn("r", rank).where(F.col("r") <= TRAIN_DOCS).select("lang", "o", "n").collect():
        wanted.setdefault(r.lang, []).append((r.o.long, r.o.h, r.n))
    keys: list[int] = []
    for lang, rows in sorted(wanted.items()):
        total = 0
        for i, (_, h, n) in enumerate(sorted(rows)):
            if i and total + n > TRAIN_BYTES:
                break
            keys.append(h)
            total += n
    pieces: dict[str, dict[int, str]] = {}
    sample = known.join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "k long")), F.col("o.h") == F.col("k"))
    for r in sample.groupBy("lang", "k").agg(F.first(F.substring("t", 1, TRAIN_BYTES)).alias("t")).collect():
        pieces.setdefault(r.lang, {})[r.k] = r.t
    texts = {}
    for lang, got in pieces.items():
        folded = []
        for _, t in sorted(got.items()):
            raw = np.frombuffer(t.encode()[:TRAIN_BYTES], np.uint8)
            folded.append(fold(raw, np.array([0, len(raw)]))[0].tobytes())
        texts[lang] = b" ".join(folded)
    return Parser(texts)


def predict(docs: DataFrame, parser: Parser, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with lang_pred and score, and the names that they got."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        p = shared.value
        bits = p.bits(*text_bytes(batch.column(batch.schema.names.index(text_col))))
        best = bits.argmin(axis=1)
        apart = bits - bits.min(axis=1, keepdims=True)
        score = 1 / np.exp2(-EVIDENCE * apart).sum(axis=1)
        return [pa.array([p.langs[i] for i in best], pa.string()), pa.array(score)]

    if not parser.langs:
        names = {c: fresh(c, docs.columns) for c in ("lang_pred", "score")}
        return docs.withColumns({names["lang_pred"]: F.lit("und"), names["score"]: F.lit(0.0)}), names
    out, names = annotate(docs, fn, {"lang_pred": "string", "score": "double"}, text_col)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({names["lang_pred"]: F.when(letters, F.col(names["lang_pred"])).otherwise("und"), names["score"]: F.when(letters, F.col(names["score"])).otherwise(0.0)}), names
