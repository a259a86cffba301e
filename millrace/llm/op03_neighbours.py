"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (`SAMPLE_ROWS` vectors in hash order): a
node splits by the hyperplane between two of its sample vectors, at the median,
until the rows it stands for are expected to number at most `LEAF_ROWS`, or a
`LEAVES`-th of the table where that is more. Every vector is then indexed in one
leaf of each tree. A query walks all trees through one shared priority queue
ordered by the smallest margin on the way, until its number of leaves is taken
(`probes_for`): a share of all leaves that falls slowly as the table grows to
LEAVES * LEAF_ROWS rows and is the same from there on, where leaves grow instead.
Candidates of the leaves are reranked exactly, by cosine in double precision on
the original vectors.

Neighbouring leaves of a tree are dealt to tasks together, about `GROUP_ROWS`
vectors at a time, and a query goes once to each such group that holds leaves of
its. A leaf of more rows is dealt in parts, to each of which its queries go; where
more than about `QUERY_ROWS` queries are expected at a group, they are dealt in
tiles, to each of which the group's rows go. So a task holds a bounded number of
vectors at once at any size.

Equal vectors are one class: the index holds a class once, with its smallest
ids (k + 1, which is all that a query can need), and equal queries are searched
once. So copies, however many, take one row in a leaf. A group's best are kept
per query before the shuffle that merges groups.

Edge cases: vectors that are null, zero, empty or hold null or non-finite
components, null ids, and vectors whose length isn't the table's commonest take
no part; rows repeated with the same id count once; with fewer candidates than
k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Workspace

TREES, LEAF_ROWS, PROBES = 16, 128, 288
SAMPLE_ROWS = 20_000
#: Distinct vectors up to which PROBES leaves are taken.
PROBE_ROWS = 50_000
#: Leaves of a tree, about, at most; rows of leaves that a task handles at once.
LEAVES, GROUP_ROWS, QUERY_ROWS = 2_048, 4_096, 50_000


def probes_for(rows: int, probes: int = PROBES) -> int:
    """Leaves that a query takes in a table of so many different vectors."""
    return int(probes * max(1.0, min(rows, LEAVES * LEAF_ROWS) / PROBE_ROWS) ** 0.75)


class Forest:
    """Flat arrays of all trees' nodes: plane, offset, children (negative: leaf)."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        each = rows / max(len(sample), 1)
        self.roots = [self._grow(sample, rng, each, leaf) for _ in range(trees)]
        dim = sample.shape[1] if sample.ndim == 2 else 0
        self.planes = np.array(self.planes, np.float64).reshape(len(self.children), dim)
        self.offsets = np.array(self.offsets)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, each: float, leaf: int) -> int:
        if len(x) * each > leaf and len(x) >= 4:
            for _ in range(3):
                plane, cut = self._plane(x, rng)
                if plane is None:
                    continue
                side = x @ plane
                low = side <= cut
                if not 0.05 < low.mean() < 0.95:
                    cut = float(np.median(side))
                    low = side <= cut
                if 0 < low.sum() < len(x):
                    at = len(self.children)
                    self.planes.append(plane)
                    self.offsets.append(cut)
                    self.children.append([0, 0])
                    self.children[at] = [self._grow(x[low], rng, each, leaf), self._grow(x[~low], rng, each, leaf)]
                    return at
        self.leaves += 1
        return -self.leaves

    @staticmethod
    def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, float]:
        """A hyperplane between two random vectors, which move to the middles of
        the halves that they part (on a few of the rows)."""
        part = x[rng.choice(len(x), min(len(x), 256), replace=False)]
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            near = part @ (a - b) > ((a + b) / 2) @ (a - b)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(axis=0), part[~near].mean(axis=0)
        plane = a - b
        norm = np.linalg.norm(plane)
        return (None, 0.0) if norm < 1e-9 else (plane / norm, float(((a + b) / 2) @ plane / norm))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(at >= 0)
                if not len(inner):
                    break
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]
                at[inner] = self.children[node, right.astype(int)]
            out[:, t] = -at
        return out

    def probe(self, q: np.ndarray, probes: int) -> list[int]:
        """Leaves in the order of a priority queue that all trees share."""
        margins = self.planes @ q - self.offsets if len(self.planes) else np.zeros(0)
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and len(out) < probes:
            cost, at = heapq.heappop(queue)
            while at >= 0:
                m = margins[at]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(cost, abs(m)), int(self.children[at, far])))
                at = int(self.children[at, near])
            out.append(-at)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def usable(vec: Column) -> Column:
    """Not null, with finite components only, not all of them zero."""
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _even(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which is exact, so that squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of one with that of the other, the same for equal rows wherever they stand."""
    q, x = _even(q), _even(x)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def _group_best(keep: int):
    """Best candidates among a group's leaves for each query that probes any."""

    def fn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((2, 0), np.int64)]
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
            uq, ux = _unit(q), _unit(x)
            lists = left["leaves"].combine_chunks()
            asks, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            leaf = right["leaf"].to_numpy()
            order, rows = np.argsort(asks, kind="stable"), np.argsort(leaf, kind="stable")
            for at in np.unique(asks):
                who = by[order[slice(*np.searchsorted(asks[order], [at, at + 1]))]]
                what = rows[slice(*np.searchsorted(leaf[rows], [at, at + 1]))]
                few = min(keep, len(what))
                for lo in range(0, len(who) if few else 0, 512):
                    part = who[lo : lo + 512]
                    rough = uq[part] @ ux[what].T
                    # those that rounding could bring among the best are scored exactly
                    bar = np.partition(rough, len(what) - few, axis=1)[:, len(what) - few]
                    i, j = np.nonzero(rough >= bar[:, None] - 1e-9)
                    found.append(np.stack([part[i], what[j]]))
        i, j = np.concatenate(found, axis=1)
        if not len(i):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        # a group may hold a row in the leaves of several trees
        xid = right["id"].to_numpy()
        once = np.unique(np.stack([i, xid[j]]), axis=1, return_index=True)[1]
        i, j = i[once], j[once]
        exact = np.concatenate([cosines(q[i[lo : lo + 50_000]], x[j[lo : lo + 50_000]]) for lo in range(0, len(i), 50_000)])
        order = np.lexsort((xid[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        best = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < keep
        i, j, exact = i[best], j[best], exact[best]
        ids = right["ids"].combine_chunks().take(pa.array(j))
        n = np.diff(ids.offsets.to_numpy())
        return pa.table({"q": left["q"].combine_chunks().take(pa.array(np.repeat(i, n))), "id": ids.flatten(), "score": pa.array(np.repeat(exact, n))})

    return fn


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF_ROWS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, id, score): the k rows nearest to each row that `is_query`."""
    spark = vectors.sparkSession
    work = Workspace(spark, "forest")
    # floats travel as floats; all arithmetic is in doubles
    kind = "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), is_query.alias("query")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0
    rows = rows.where(F.size("vec") == dim)

    # a class of equal vectors: its smallest ids, and whether a query is among all of its ids
    same = Window.partitionBy("vec")
    ranked = rows.select("id", "vec").withColumn("r", F.row_number().over(same.orderBy("id"))).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.min("id").alias("class"), F.array_sort(F.collect_set("id")).alias("ids"))
    asked = rows.where("query").select("id", "vec")
    wanted = asked.groupBy("vec").agg(F.lit(True).alias("wanted"))
    classes = work.table(classes.join(wanted, "vec", "left").select("class", "ids", "vec", F.coalesce("wanted", F.lit(False)).alias("wanted")), "classes")
    members = asked.join(classes.where("wanted").select("vec", F.col("class").alias("q")), "vec").select(F.col("id").alias("query_id"), "q")

    n = classes.count()
    sample = classes.select("class", "vec").orderBy(F.xxhash64("class"), "class").limit(SAMPLE_ROWS).collect()
    rows_of_leaf = max(leaf, n // LEAVES)
    forest = Forest(_unit(np.array([r.vec for r in sample], np.float64).reshape(len(sample), dim)) if sample else np.zeros((0, 1)), n, trees, rows_of_leaf)
    probes = probes_for(n, probes)
    together, parts = max(1, GROUP_ROWS // rows_of_leaf), -(-rows_of_leaf // GROUP_ROWS)
    expected = classes.where("wanted").count() * min(1.0, probes * together / max(forest.leaves, 1))
    tiles = max(1, int(-(-expected // QUERY_ROWS)))
    shared = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = shared.value.leaf_of(_unit(_matrix(batch.column(2))))
                row = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
                part, leaves = batch.take(row), at.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(leaves // together), pa.array(leaves), part.column(0), part.column(1), part.column(2)], ["grp", "leaf", "id", "ids", "vec"])

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                row, group, leaves = [], [], []
                for i, q in enumerate(_unit(_matrix(batch.column(1)))):
                    by: dict[int, list[int]] = {}
                    for x in shared.value.probe(q, probes):
                        by.setdefault(x // together, []).append(x)
                    row += [i] * len(by)
                    group += by
                    leaves += by.values()
                part = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), part.column(0), part.column(1)], ["grp", "leaves", "q", "vec"])

    index = classes.select("class", "ids", "vec").mapInArrow(place, f"grp long, leaf long, id long, ids array<long>, vec array<{kind}>").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("tile", F.expr(f"explode(sequence(0L, {tiles - 1}L))"))
    queries = classes.where("wanted").select("class", "vec").mapInArrow(ask, f"grp long, leaves array<long>, q long, vec array<{kind}>").withColumn("part", F.expr(f"explode(sequence(0L, {parts - 1}L))")).withColumn("tile", F.pmod(F.xxhash64("q"), F.lit(tiles)))
    best = queries.groupBy("grp", "part", "tile").cogroup(index.groupBy("grp", "part", "tile")).applyInArrow(_group_best(k + 1), "q long, id long, score double")
    found = best.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("down"), "id"))), 1, k + 1).alias("near"))
    # each query of a class drops itself
    rest = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = members.join(found, "q").select("query_id", F.posexplode(rest).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.down")).alias("score")).dropDuplicates(["query_id", "rank"])
