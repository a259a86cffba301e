"""Strings, names and JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def empty_to_null(c: Column) -> Column:
    """The empty string counts as null."""
    return F.nullif(c, F.lit(""))


def is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def not_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def to_snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def rename_camel(df: DataFrame) -> DataFrame:
    """Columns from snake_case to camelCase."""
    return df.toDF(*(to_camel(c) for c in df.columns))


def bean_json(df: DataFrame, hidden: tuple[str, ...] = ()) -> Column:
    """A row as JSON with snake_case names; hidden columns and nulls are left out."""
    return F.to_json(F.struct(*(F.col(c).alias(to_snake(c)) for c in df.columns if c not in hidden)))


def cache_key(table: str, key: Column) -> Column:
    """`table:key`."""
    return F.concat(F.lit(table + ":"), key.cast("string"))


def kept_columns(data: Column, csv: Column) -> Column:
    """Entries of a map whose names stand in a comma-separated list (no trimming)."""
    names = F.split(csv, ",")
    return F.map_filter(data, lambda k, _: F.array_contains(names, k))
