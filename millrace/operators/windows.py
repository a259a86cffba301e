"""Tumbling windows and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import DATE, DATETIME


def tumble(df: DataFrame, time: str, size: str, keys: list[str], **measures: Column) -> DataFrame:
    """Measures per window [start, end) and keys, led by stt, edt and cur_date (of the start)."""
    out = df.groupBy(F.window(time, size), *keys).agg(*(c.alias(k) for k, c in measures.items()))
    stt, edt = F.col("window.start"), F.col("window.end")
    return out.select(F.date_format(stt, DATETIME).alias("stt"), F.date_format(edt, DATETIME).alias("edt"), F.date_format(stt, DATE).alias("cur_date"), *keys, *measures)


def distinct_in_stream(c: Column) -> Column:
    """Exact distinct count where streams refuse count(distinct)."""
    return F.size(F.collect_set(c)).cast("long")
