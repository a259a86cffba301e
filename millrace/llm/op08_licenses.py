"""License scans by diagonal voting.

Every word k-gram of a text (k = 2) is hashed and joined to the positions of the
same k-gram in license templates. A match at text word p and template word t
votes for the diagonal p - t. Votes are aggregated per text, template and
diagonal into the set of template positions that the diagonal covers. Diagonals
of a template that lie close together (a few words inserted or left out) are
merged in tiles that overlap by half, so that any span whose diagonals lie within
one tile's half is whole in one of them. A merged span is verified by the longest
run of its votes that goes forward both in the text and in the template: the
share of the template's k-grams in it must reach `COVER`. Votes that repeat the
same few template positions, or that stand in another order, don't add up.

A short phrase is a template that must be covered wholly on one diagonal, which
is the same as its words standing consecutively.

All is DataFrame and SQL code. The templates are a fixed list, so their table
is broadcast; texts are never shuffled, and the votes that are (few of a text's
words) are pre-aggregated per diagonal. A tile holds at most as many diagonals as
it is wide and as many votes of each as the template has words.

Edge cases: a null text is empty; rows repeated with the same id and text get
the same result each; a null id is an id like another; a very long text is read
whole, its votes being rows; of spans that begin at one word the best covered
one counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace

# Phrases that are found wherever their words stand, and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Wording of public license notices, and their labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd-4.0"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("distributed under the boost software license version 1 0", "bsl-1.0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: A tile of diagonals is at least so wide, or half as wide as the template is long.
TILE = 16
#: Least share of a long template's k-grams that a span covers in order.
COVER = 0.75


def words(text: Column) -> Column:
    """Lower-cases A-Z; runs of digits, letters and anything beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def template_table(spark: SparkSession) -> DataFrame:
    """(gram, tpl, bit) of all templates: a fixed, small table.

    A template has at most 63 k-grams, so that a set of its positions is one number.
    """
    rows = [(i, text) for i, (text, _) in enumerate([*PHRASES, *TEMPLATES])]
    tpl = spark.createDataFrame(rows, "tpl int, text string").withColumn("w", F.split("text", " "))
    return tpl.select("tpl", F.expr("inline(transform(sequence(0, size(w) - 2), i -> struct(i as t, xxhash64(w[i], w[i + 1]) as gram)))"))


def labels_table(spark: SparkSession) -> DataFrame:
    """(tpl, label, phrase, grams): a fixed, small table."""
    rows = [(i, label, i < len(PHRASES), len(text.split()) - 1) for i, (text, label) in enumerate([*PHRASES, *TEMPLATES])]
    assert max(r[3] for r in rows) <= 63
    return spark.createDataFrame(rows, "tpl int, label string, phrase boolean, grams int")


#: Votes of a tile in text order, then the longest forward run: for each length
#: the run that ends earliest in the template, as (t, first, last).
_VOTES = "array_sort(flatten(transform(diagonals, x -> transform(filter(sequence(0, grams - 1), t -> getbit(x.at, t) = 1), t -> struct(x.d + t as p, -t as back)))))"
_RUNS = """aggregate(votes, cast(array() as array<struct<t:int,first:int,last:int>>), (s, v) -> concat(
  filter(s, x -> x.t < -v.back),
  array(struct(-v.back as t, coalesce(try_element_at(filter(s, x -> x.t < -v.back), -1).first, v.p) as first, v.p as last)),
  slice(filter(s, x -> x.t >= -v.back), 2, size(s))))"""


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, n_words) of `docs`, and the verified spans
    (id, h, label, phrase, first, last, cover), h being the text's hash and last
    the word after the span."""
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), words(F.col(text_col)).alias("w"))
    grams = base.select("id", "h", F.posexplode(F.arrays_zip("w", F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("v"))).alias("p", "z")).where("z.v is not null")
    grams = grams.select("id", "h", "p", F.xxhash64("z.w", "z.v").alias("gram"))
    votes = grams.join(F.broadcast(template_table(spark)), "gram")
    # the positions that a diagonal covers are a set: a repeated row adds nothing
    diagonals = votes.groupBy("id", "h", "tpl", (F.col("p") - F.col("t")).alias("d")).agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("at"))
    diagonals = work.table(diagonals.join(F.broadcast(labels_table(spark)), "tpl"), "diagonals")
    phrases = diagonals.where("phrase and bit_count(at) = grams").select("id", "h", "label", "phrase", F.col("d").alias("first"), (F.col("d") + F.col("grams") + 1).alias("last"), F.lit(1.0).alias("cover"))
    half = f"(greatest({TILE}, grams) div 2)"
    tiles = diagonals.where("not phrase").withColumn("tile", F.explode(F.expr(f"array(cast(floor(d / {half}) as int), cast(floor(d / {half}) as int) - 1)")))
    tiles = tiles.groupBy("id", "h", "tpl", "label", "grams", "tile").agg(F.sum(F.expr("bit_count(at)")).alias("n"), F.bit_or("at").alias("all"), F.collect_list(F.struct("d", "at")).alias("diagonals"))
    tiles = tiles.where(f"bit_count(all) >= {COVER} * grams").withColumn("votes", F.expr(_VOTES)).withColumn("runs", F.expr(_RUNS))
    runs = tiles.select("id", "h", "label", F.expr("size(runs) / grams").alias("cover"), F.size("runs").alias("n"), F.expr("element_at(runs, -1)").alias("r")).where(f"cover >= {COVER}")
    best = runs.groupBy("id", "h", F.col("r.first").alias("first")).agg(F.max(F.struct("cover", "n", "label", (F.col("r.last") + 2).alias("last"))).alias("b"))
    spans = best.select("id", "h", "b.label", F.lit(False).alias("phrase"), "first", "b.last", "b.cover")
    return base.select("id", "h", F.size("w").cast("long").alias("n_words")), phrases.unionByName(spans)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base (places of phrases), first_word and last_word
    (their smallest and largest first word), base_labels, labels, score (largest
    share of a template covered)."""
    rows, spans = license_spans(docs, id_col, text_col)
    base = F.when(F.col("phrase"), F.col("first"))
    found = spans.groupBy("id", "h").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.least(F.max("cover"), F.lit(1.0)).alias("score"),
    )
    found = found.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    empty = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(F.col("id").alias(id_col), "n_words", *(F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
