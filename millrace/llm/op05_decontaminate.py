"""Benchmark decontamination by a prefix-filtered set join.

A window is `width` consecutive words of an item (an item of fewer words is one
window of its own length). A document contains a window if all of the window's
words stand there consecutively.

Method. A window's tokens are its `SHINGLE`-word shingles. Full containment
needs every token, so a prefix of one token is enough, and the rarest serves
best: the corpus frequency of all tokens of windows is counted over all
documents. Each document position that holds a prefix token proposes windows;
the positional bound turns the token's offset into the window's start, the
length bound drops starts from which the window doesn't fit, and the window is
verified at that start word by word, byte by byte.

The windows are taken in blocks of at most `BLOCK_WINDOWS`, a proven size: a
window of ten words of ten letters is some 300 bytes there, so a block is some
30 MB on the driver and in each Python worker. One block is searched in one pass
that leaves documents where they are. Of more blocks, each is searched by a job of
its own, so that no worker holds two; what it finds is written, and joined to the
documents at the end.

Edge cases: null and empty texts have no words; a very long text is searched
whole; rows repeated with one id and text are judged alike; item ids may be of any
type and count as text; items with a null id are no items; no items or no
documents give zeros or an empty result; extra columns pass through, and where
one is called like a result, the result gets underscores in front of its name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .words import ALNUM, Words, annotate, fresh, gram_hash, map_texts, text_bytes

SHINGLE = 3
BLOCK_WINDOWS = 100_000
FIELDS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(width: int):
    """Windows of items: item id, words, their letters and lengths, token hashes."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(batch.column(1)), ALNUM)
        h = w.hashes()
        length = np.minimum(w.count, width)
        n = np.where(w.count > 0, w.count - length + 1, 0)
        item = np.repeat(np.arange(w.texts), n)
        at = ragged(w.first[:-1], n)
        m = length[item]
        letters, sizes, tokens = [], [], []
        for s, k in zip(at.tolist(), m.tolist(), strict=True):
            size = w.end[s : s + k] - w.start[s : s + k]
            letters.append(w.bytes[ragged(w.start[s : s + k], size)].tobytes())
            sizes.append(size.astype(np.int32))
            few = min(SHINGLE, k)
            tokens.append(gram_hash([h[s + j : s + j + k - few + 1] for j in range(few)]).view(np.int64))
        cols = [batch.column(0).take(pa.array(item)), pa.array(m.astype(np.int32)), pa.array(letters, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["item", "m", "letters", "sizes", "tokens"])

    return fn


class _Found:
    """Membership of 64-bit values in a fixed set: a bitmap first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x, and numbers of the values found there."""
        at = np.flatnonzero(self.bits[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[to] == x[at]
        return at[ok], to[ok]


def _counts(finders: dict[int, _Found]):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(batch.column(0)), ALNUM)
        h = w.hashes()
        kinds, keys, ns = [], [], []
        for k, find in finders.items():
            n = np.bincount(find(w.grams(k, h)[0])[1], minlength=len(find.values))
            on = np.flatnonzero(n)
            kinds.append(np.full(len(on), k, np.int32))
            keys.append(find.values[on])
            ns.append(n[on])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ns).astype(np.int64))], ["k", "token", "n"])

    return fn


def _block(docs: DataFrame, text: str, windows: pa.Table) -> dict:
    """Search tables of one block, with prefix tokens chosen by corpus frequency."""
    windows = windows.combine_chunks()
    m = windows["m"].to_numpy().astype(np.int64)
    values = np.concatenate([x.values.to_numpy() for x in windows["tokens"].chunks] or [np.zeros(0, np.int64)]).view(np.uint64)
    n = np.maximum(m - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    kind = np.repeat(np.minimum(m, SHINGLE), n)
    finders = {int(k): _Found(values[kind == k]) for k in np.unique(kind)}
    often = np.zeros(len(values), np.int64)
    if finders:
        seen = map_texts(docs.select(F.col(text).alias("text")), _counts(finders), "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n")).toArrow()
        for k, find in finders.items():
            own = np.flatnonzero(seen["k"].to_numpy() == k)
            count = np.zeros(len(find.values), np.int64)
            count[np.searchsorted(find.values, seen["token"].to_numpy()[own].view(np.uint64))] = seen["n"].to_numpy()[own]
            rows = np.flatnonzero(kind == k)
            often[rows] = count[np.searchsorted(find.values, values[rows])]
    # the rarest token of each window, the first of equal ones
    owner = np.repeat(np.arange(len(m)), n)
    order = np.lexsort((np.arange(len(values)), values, often, owner))
    best = order[first[:-1]] if len(m) else order
    prefix, offset = values[best], best - first[:-1]
    table = {}
    for k in finders:
        own = np.flatnonzero(np.minimum(m, SHINGLE) == k)
        own = own[np.argsort(prefix[own], kind="stable")]
        find = _Found(prefix[own])
        at = np.searchsorted(prefix[own], find.values)
        table[k] = (find, at, np.append(at[1:], len(own)), own)
    words_of = np.concatenate([[0], np.cumsum(m)])
    sizes = np.concatenate([x.values.to_numpy() for x in windows["sizes"].chunks] or [np.zeros(0, np.int32)]).astype(np.int64)
    letters = np.frombuffer(b"".join(windows["letters"].to_pylist()), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[words_of]
    return {"m": m, "offset": offset, "table": table, "items": windows["items"].to_pylist(), "words": words_of, "sizes": sizes, "letters": letters, "starts": starts}


def _equal(w: Words, start: np.ndarray, win: np.ndarray, b: dict) -> np.ndarray:
    """Do the windows' words stand at these words of the texts?"""
    m = b["m"][win]
    here, there = ragged(start, m), ragged(b["words"][win], m)
    size = (w.end - w.start)[here]
    owner = np.repeat(np.arange(len(win)), m)
    ok = np.bincount(owner, size != b["sizes"][there], minlength=len(win)) == 0
    # letters are compared where all words are as long
    keep = ok[owner]
    here, size, owner = here[keep], size[keep], owner[keep]
    total = np.bincount(owner, size, minlength=len(win)).astype(np.int64)
    same = w.bytes[ragged(w.start[here], size)] == b["letters"][ragged(b["starts"][win], total)]
    return ok & (np.bincount(np.repeat(owner, size), ~same, minlength=len(win)) == 0)


def _search(w: Words, h: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """First words (numbers over all texts) and window numbers of all occurrences."""
    starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (find, first, last, own) in b["table"].items():
        g, at = w.grams(k, h)
        pos, to = find(g)
        n = (last - first)[to]
        win = own[ragged(first[to], n)]
        here = at[np.repeat(pos, n)]
        text = w.text[here]
        start = here - b["offset"][win]
        fits = np.flatnonzero((start >= w.first[text]) & (start + b["m"][win] <= w.first[text + 1]))
        for lo in range(0, len(fits), SLICE):
            part = fits[lo : lo + SLICE]
            ok = part[_equal(w, start[part], win[part], b)]
            starts.append(start[ok])
            wins.append(win[ok])
    return np.concatenate(starts), np.concatenate(wins)


#: Candidates that are compared at once.
SLICE = 50_000


def _finds(w: Words, b: dict) -> tuple[list[list], list[set]]:
    """Per text: (first word, words) of occurrences, and items with any."""
    start, win = _search(w, w.hashes(), b)
    owner = w.text[start]
    spans: list[list] = [[] for _ in range(w.texts)]
    ids: list[set] = [set() for _ in range(w.texts)]
    for t, s, i in zip(owner.tolist(), (start - w.first[owner]).tolist(), win.tolist(), strict=True):
        spans[t].append((s, int(b["m"][i])))
        ids[t].update(b["items"][i])
    return spans, ids


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns of FIELDS, and the names that they got.

    n_words; n_hit, the words inside any occurrence of a window; n_items, the
    items with occurring windows; items_sha256 over their sorted ids;
    contaminated, n_hit > 0.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "windows")
    windows = map_texts(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")), _windows(width), "item string, m int, letters binary, sizes array<int>, tokens array<long>")
    windows = windows.groupBy("letters", "sizes").agg(F.first("m").alias("m"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))
    windows = work.table(windows, "windows")
    blocks = max(1, math.ceil(windows.count() / BLOCK_WINDOWS))
    parts = []
    for number in range(blocks):
        held = windows.where(F.pmod(F.xxhash64("letters", "sizes"), F.lit(blocks)) == number).toArrow()
        block = spark.sparkContext.broadcast(_block(docs, text_col, held))
        if blocks == 1:
            return _in_place(docs, text_col, block)
        parts.append(work.table(_found_in(docs, text_col, block), f"block{number}"))
        block.destroy()
    return _joined(work, docs, text_col, parts)


def _in_place(docs: DataFrame, text: str, block) -> tuple[DataFrame, dict[str, str]]:
    """One block: a row gets its result where it is."""

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        w = Words(*text_bytes(batch.column(batch.schema.names.index(text))), ALNUM)
        spans, ids = _finds(w, block.value)
        hit = [_covered(x) for x in spans]
        return [pa.array(w.count), pa.array(hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([_digest(i) for i in ids]), pa.array([n > 0 for n in hit])]

    return annotate(docs, fn, FIELDS, text)


def _key(text: str) -> Column:
    """What a text is known by in the tables of finds: 128 bits of its digest and its length."""
    return F.concat(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("string"))


def _found_in(docs: DataFrame, text: str, block) -> DataFrame:
    """(key, starts, sizes, items) of different texts with finds of one block."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(batch.column(1)), ALNUM)
        spans, ids = _finds(w, block.value)
        on = [t for t in range(w.texts) if spans[t]]
        cols = [pa.array([[s for s, _ in spans[t]] for t in on], pa.list_(pa.int64())), pa.array([[m for _, m in spans[t]] for t in on], pa.list_(pa.int64())), pa.array([sorted(ids[t]) for t in on], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on, pa.int64())), *cols], ["key", "starts", "sizes", "items"])

    found = map_texts(docs.select(_key(text).alias("key"), F.col(text).alias("text")), fn, "key string, starts array<long>, sizes array<long>, items array<string>")
    return found.dropDuplicates(["key"])


def _joined(work: Workspace, docs: DataFrame, text: str, parts: list[DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """Finds of all blocks by text, and `docs` with the results."""
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    found = found.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [_covered(zip(s, m, strict=True)) for s, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        ids = batch.column(3).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([_digest(i) for i in ids])], ["key", "hit", "n", "sha"])

    result = work.table(found.mapInArrow(lambda it: (fn(x) for x in it), "key string, hit long, n long, sha string"), "finds")
    names = {c: fresh(c, docs.columns) for c in FIELDS}
    key, hit, n, sha = (fresh(f"_{c}", [*docs.columns, *names.values()]) for c in ("key", "hit", "n", "sha"))
    counted, own = annotate(docs, lambda batch: [pa.array(Words(*text_bytes(batch.column(batch.schema.names.index(text))), ALNUM).count)], {"n_words": "long"}, text)
    out = counted.withColumn(key, _key(text)).join(result.toDF(key, hit, n, sha), key, "left")
    values = {"n_words": F.col(own["n_words"]), "n_hit": F.coalesce(F.col(hit), F.lit(0)), "n_items": F.coalesce(F.col(n), F.lit(0)), "items_sha256": F.coalesce(F.col(sha), F.lit(_digest([]))), "contaminated": F.coalesce(F.col(hit), F.lit(0)) > 0}
    return out.select(*docs.columns, *(values[c].alias(names[c]) for c in FIELDS)), names


def _covered(spans) -> int:
    """Words inside any of the spans (start, words)."""
    total, end = 0, -1
    for s, m in sorted(set(spans)):
        total += max(0, s + m - max(s, end))
        end = max(end, s + m)
    return total
