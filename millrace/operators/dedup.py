"""Repeated facts: latest versions, and the retractions that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key, of equal ones the largest by its other columns.

    A maximum over one struct that begins with the order: pre-aggregated, so versions
    of a key don't meet in one task first, and no column travels twice.
    """
    first = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in first]
    if not first + rest:
        return df.select(*keys).distinct()
    sortable = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    if len(sortable) < len(rest):  # maps have no order
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*first, *rest), F.struct(*first, *sortable)).alias("v"))
    else:
        best = df.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("v"))
    return best.select(*(F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in df.columns))


def retractions(df: DataFrame, keys: list[str], order: list[str], amounts: list[str]) -> DataFrame:
    """Each version, and for each one that is replaced its negation with the replacing version's order.

    Sums over the result telescope to the sums over latest versions. Null amounts
    stay null; amounts are numbers, so negating one twice gives it back.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("_next", F.lead(F.struct(*order)).over(by_key)).where(F.col("_next").isNotNull())
    negated = before.select(*(F.col(f"_next.{c}").alias(c) if c in order else (-F.col(c)).alias(c) if c in amounts else F.col(c) for c in df.columns))
    return df.unionByName(negated)
