"""Keyword analysis as column expressions.

Words of letters and digits are lower-cased; runs of Han characters are cut by
greedy longest match against a dictionary, single characters where none fits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HAN = r"一-鿿"


def keyword_pattern(dictionary: tuple[str, ...] = ()) -> str:
    """A pattern whose matches are the keywords, longest dictionary words first."""
    words = sorted({w for w in dictionary if w}, key=lambda w: (-len(w), w))
    listed = "".join(re.escape(w) + "|" for w in words)
    return rf"{listed}[{HAN}]|(?:(?![{HAN}])[\p{{L}}\p{{N}}])+"


def keywords(text: Column, dictionary: tuple[str, ...] = ()) -> Column:
    """Keywords of a text in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(keyword_pattern(tuple(w.lower() for w in dictionary))), F.lit(0)), F.array().cast("array<string>"))


def explode_keywords(df: DataFrame, text: str, out: str = "keyword", dictionary: tuple[str, ...] = ()) -> DataFrame:
    """One row per keyword; a row without any is dropped, as by a lateral join."""
    return df.withColumn(out, F.explode(keywords(F.col(text), dictionary)))


def register_keyword_function(spark: SparkSession, name: str = "keyword_split", dictionary: tuple[str, ...] = ()) -> None:
    """A table function for SQL: ``FROM t, LATERAL keyword_split(t.text)`` gives a `word` a row.

    It does what `keywords` does; DataFrame code should use that, which stays in the JVM.
    """
    import regex

    pattern = regex.compile(keyword_pattern(tuple(w.lower() for w in dictionary)))

    class Split:
        def eval(self, text: str):
            for m in pattern.finditer((text or "").lower()):
                yield (m.group(),)

    spark.udtf.register(name, F.udtf(Split, returnType="word: string"))
