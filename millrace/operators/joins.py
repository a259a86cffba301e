"""Joins of facts with facts and with dimensions.

No join carries a broadcast hint: the planner broadcasts what its statistics
show to be small, and splits skewed partitions of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], before: str, after: str, left_time: str = "et", right_time: str = "et") -> DataFrame:
    """Pairs with equal keys whose right time lies in [left - before, left + after], both ends in.

    Columns of both sides stay, the right side's keys and time prefixed by `r_`.
    """
    clash = {c for c in right.columns if c in left.columns}
    r = right.select(*(F.col(c).alias(f"r_{c}" if c in clash else c) for c in right.columns))
    name = lambda c: f"r_{c}" if c in clash else c
    on = F.lit(True)
    for k in keys:
        on = on & (left[k] == r[name(k)])
    time = r[name(right_time)]
    on = on & (time >= left[left_time] - F.expr(f"interval {before}")) & (time <= left[left_time] + F.expr(f"interval {after}"))
    return left.join(r, on)


def lookup_join(facts: DataFrame, dictionary: DataFrame, key: str, dict_key: str, value: str, out: str, how: str = "inner") -> DataFrame:
    """The dictionary's current value for a fact's key; the dictionary may serve several keys."""
    d = dictionary.select(F.col(dict_key).alias(f"_{out}_key"), F.col(value).alias(out))
    return facts.join(d, F.col(key) == F.col(f"_{out}_key"), how).drop(f"_{out}_key")


def enrich(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Dimension columns (source: target) by key; a miss leaves them null."""
    d = dim.select(F.col(dim_key).alias("_dim_key"), *(F.col(s).alias(t) for s, t in columns.items()))
    return facts.join(d, F.col(key) == F.col("_dim_key"), "left").drop("_dim_key")


def snowflake(root: DataFrame, *levels: tuple[DataFrame, str, str, dict[str, str]]) -> DataFrame:
    """A chain of `enrich`: each level's key may come from the level before."""
    for dim, key, dim_key, columns in levels:
        root = enrich(root, dim, key, dim_key, columns)
    return root


def changelog_left_join(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str) -> DataFrame:
    """The messages of an eager left outer join, as op ('+I' or '-D') rows.

    A left row with an earlier match comes out joined; one whose first match
    arrives later comes out alone, is retracted by that match and comes out
    joined; further matches only add rows.
    """
    r = right.select(*(F.col(c).alias(c if c == key else f"r_{c}") for c in right.columns))
    pairs = left.join(r, key).withColumn("at", F.greatest(order_left, f"r_{order_right}")).withColumn("op", F.lit("+I"))
    first = right.groupBy(key).agg(F.min(order_right).alias("first"))
    alone = left.join(first, key, "left").where(F.col("first").isNull() | (F.col("first") > F.col(order_left)))
    nulls = {f"r_{c}": F.lit(None).cast(right.schema[c].dataType) for c in right.columns if c != key}
    early = alone.withColumns(nulls | {"at": F.col(order_left), "op": F.lit("+I")})
    back = alone.where(F.col("first").isNotNull()).withColumns(nulls | {"at": F.col("first"), "op": F.lit("-D")})
    cols = ["op", "at", *left.columns, *nulls]
    return pairs.select(cols).unionByName(early.select(cols)).unionByName(back.select(cols))


def any_of(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out
