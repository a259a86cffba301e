"""Connected components over an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def connect(work: Workspace, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id that an edge (a, b) names: the smallest id reachable.

    `labels` are the components of earlier edges, which `edges` are added to.

    Each round gives a node the least label among its own and its neighbours'
    and then that label's own label (pointer jumping). The edges are then
    contracted: those within a component go, the rest run between labels. So edges
    shrink from round to round. Joins are splittable by adaptive skew handling and
    minima are pre-aggregated, so a node with very many edges doesn't land in one
    task. Each round's labels and edges are written tables, where lineage ends.
    """
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    if labels is None:
        found = ends.select("id", F.col("id").alias("component"))
    else:
        found = labels.union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    rows = 2 * edges.count() + (labels.count() if labels is not None else 0)
    found = work.table(found, "labels", rows)

    def contract(cur: DataFrame, to: DataFrame) -> DataFrame:
        """Edges between labels, without those within one."""
        x = cur.join(to.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        return work.table(x.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", rows)

    cur = edges if labels is None else contract(edges, found)
    while not cur.isEmpty():
        had = (cur, found)
        both = cur.select(F.col("a").alias("id"), F.col("b").alias("other")).union(cur.select(F.col("b").alias("id"), F.col("a").alias("other")))
        near = work.table(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("mid")), "near", rows)
        step = near.join(near.select(F.col("id").alias("mid"), F.col("mid").alias("top")), "mid").select("id", F.col("top").alias("component"))
        step = work.table(step, "step", rows)
        found = found.join(step.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        found = work.table(found, "labels", rows)
        cur = contract(cur, step)
        # `edges` is the caller's and isn't known here; all else that came before has been read for the last time
        work.drop(near, step, had[1], *([had[0]] if had[0] is not edges else []))
    return found
