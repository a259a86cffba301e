"""Vectorised words, hashes and shingles over Arrow text columns.

Everything here works on bytes of UTF-8 in numpy. A batch is cut into chunks of
a few MB at row borders, so memory follows the chunk (or the longest single
text), not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 500_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Odd 64-bit multipliers of the polynomial and of the k-gram mix.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_GRAM = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC6A4A7935BD1E995]


def letter_table(keep: Callable[[int], bool]) -> np.ndarray:
    """Bool per byte value: does it belong to a word?"""
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Words are runs of anything but ASCII white space.
NOT_SPACE = letter_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of digits, letters and everything beyond ASCII (after lower-casing A-Z).
ALNUM = letter_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower-cases A-Z alone.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        _powers[name] = have
    return have[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


class Words:
    """Words of several texts: start and end byte, text number, hash."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, keep: np.ndarray, lower: bool = True):
        n = len(raw)
        self.bytes = LOWER[raw] if lower else raw
        self.texts = len(off) - 1
        self.off = off
        inside = keep[self.bytes]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:n]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.text = np.searchsorted(off, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=self.texts).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same wherever the word stands."""
        n = len(self.bytes)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _power(_P, n, "p"), out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * _power(_P_INV, n, "inv")[self.start])

    def prefix_hashes(self, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: numbers of the words with so many code points or more, and the hash of that prefix."""
        n = len(self.bytes)
        if not len(self.start):
            return [(np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in sizes]
        lead = (self.bytes & 0xC0) != 0x80
        point = np.concatenate([[0], np.cumsum(lead)])
        where = np.append(np.flatnonzero(lead), n)
        first, length = point[self.start], point[self.end] - point[self.start]
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _power(_P, n, "p"), out=sums[1:])
            back = _power(_P_INV, n, "inv")
            out = []
            for size in sizes:
                at = np.flatnonzero(length >= size)
                s = self.start[at]
                out.append((at, mix(((sums[where[first[at] + size]] - sums[s]) * back[s]) ^ np.uint64(size))))
        return out

    def grams(self, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within a text, and the number of its first word."""
        h = self.hashes() if h is None else h
        at = np.flatnonzero(np.arange(len(h)) + k <= self.first[1:][self.text]) if len(h) else np.zeros(0, np.int64)
        return gram_hash([h[at + j] for j in range(k)]), at


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word hashes in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for j, x in enumerate(parts):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(_GRAM[j % len(_GRAM)]) + x
        return mix(out)


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, a row at least."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over chunks bounded in bytes.

    A session that doesn't say how many rows an Arrow batch has gets 1000, for texts
    are long; one that says so keeps its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                out = fn(part)
                if out.num_rows:
                    yield out

    spark = df.sparkSession
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "1000")
    return df.mapInArrow(run, schema)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values and list lengths."""
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or with underscores in front so that it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def annotate(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: dict[str, str], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns that `fn` gives for each chunk, and the names that they got."""
    names = {c: fresh(c, df.columns) for c in fields}
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = own + "".join(f", `{names[c]}` {kind}" for c, kind in fields.items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], [*batch.schema.names, *names.values()])

    return map_texts(df, run, schema, text), names
