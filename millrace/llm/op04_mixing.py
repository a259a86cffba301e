"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. The cells' token
weights are raked: each sweep scales them to one margin's targets after the
other, until all margins fit. A cell's factor is its raked share over its own
share. The budget is a share of all tokens, and no document is taken twice, so
a value's target is at most its own tokens: what it lacks goes to the other
values of its margin in proportion (`bound`). Cells are then raked once more,
from factors times a constant, with probabilities of at most 1: capped cells
stay at 1 and the free ones fill the margins, until the expected tokens of the
sample fit. A document is kept if a hash of its id and the seed, as a number in
[0, 1), is below its cell's probability, so the sample is the same on every run
and partitioning.

DataFrame and SQL code only. What is raked are cells, pre-aggregated before the
shuffle; they are gathered in one partition, and broadcast to the documents,
only where a count shows that they are at most `FEW_CELLS`.

Targets of a margin are either given shares by value (values not named share
the rest in proportion) or its own token shares to the power `temper`.

Targets can contradict each other (sources of one language only, say). Raking
then ends after `SWEEPS` sweeps: the last margin (topic) has its targets, the
others don't, and a warning names the largest gap.

Edge cases: null in a margin is one value with the empty string; null and empty
texts have no tokens, and their probability is that of their cell; a very long
text counts like any other; given shares that sum to more than 1 are divided by
their sum, and values that aren't named then get nothing; cells without tokens are kept whole with their factor 1; a null id
hashes as an empty string; repeated rows share their fate; an empty table gives
an empty result; extra columns pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Workspace
from .words import fresh

FEW_CELLS = 100_000
SWEEPS, BLOCK, CLOSE = 40, 8, 1e-6
#: Most sweeps with probabilities of at most 1, and the gap in shares of all tokens at which they end.
BOUND_SWEEPS, BOUND_CLOSE = 160, 1e-4


def topic_of(text: Column) -> Column:
    """A coarse topic by the text's form: tabular, brief, long or prose."""
    n = F.length(text)
    pipes = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(text.isNull() | (n < 400), "brief").when(pipes * 100 > n, "tabular").when(n > 8000, "long").otherwise("prose")


def token_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _targets(cells: DataFrame, dim: str, temper: float, given: dict[str, float] | None) -> Column:
    """Each value's share of the margin."""
    own = F.sum("tokens").over(Window.partitionBy(dim)).cast("double")
    total = F.sum("tokens").over(Window.partitionBy()).cast("double")
    if given is None:
        # a value's power, divided by the sum of powers over values
        part = F.when(own > 0, F.pow(own / total, F.lit(temper))).otherwise(0.0)
        return part
    named = F.lit(None).cast("double")
    for value, share in sorted(given.items()):
        named = F.when(F.col(dim) == value, F.lit(float(share))).otherwise(named)
    return F.coalesce(named, F.lit(-1.0) * own / total)


def rake(work: Workspace, counted: DataFrame, dims: list[str], temper: float = 0.7, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, bool]:
    """Cells with `factor` (raked share over own share), and whether they are few.

    `counted` has the dims, `tokens` and `docs` of each cell.
    """
    cells = work.table(counted, "cells")
    few = cells.count() <= FEW_CELLS
    if few:
        cells = cells.repartition(1).sortWithinPartitions(*dims)
    total = F.sum("tokens").over(Window.partitionBy()).cast("double")
    cells = cells.withColumn("own", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    for d in dims:
        raw = _targets(cells, d, temper, (targets or {}).get(d))
        cells = cells.withColumn(f"raw_{d}", raw)
        # over values, not cells: the first cell of each value counts
        cells = cells.withColumn("one", F.row_number().over(Window.partitionBy(d).orderBy(*dims)) == 1)
        value = F.when(F.col("one"), F.col(f"raw_{d}")).otherwise(0.0)
        over = Window.partitionBy()
        fixed, loose = F.sum(F.greatest(value, F.lit(0.0))).over(over), F.sum(F.least(value, F.lit(0.0))).over(over)
        cells = cells.withColumns({"fixed": fixed, "loose": loose})
        rest = F.greatest(F.lit(1.0) - F.col("fixed"), F.lit(0.0))
        share = F.when(F.col(f"raw_{d}") >= 0, F.when(F.col("loose") < 0, F.col(f"raw_{d}") / F.greatest(F.col("fixed"), F.lit(1.0))).otherwise(F.col(f"raw_{d}") / F.col("fixed"))).otherwise(F.col(f"raw_{d}") / F.col("loose") * rest)
        cells = cells.withColumn(f"t_{d}", F.coalesce(share, F.lit(0.0))).drop("one", f"raw_{d}", "fixed", "loose")
    cells = cells.withColumn("w", F.col("own"))
    for _ in range(SWEEPS // BLOCK):
        if few:
            cells = cells.repartition(1).sortWithinPartitions(*dims)
        for _ in range(BLOCK):
            for d in dims:
                margin = F.sum("w").over(Window.partitionBy(d))
                cells = cells.withColumn("w", F.when(margin > 0, F.col("w") * F.col(f"t_{d}") / margin).otherwise(0.0))
        cells = work.table(cells, "raked")
        off = [F.max(F.col(f"off_{d}")).alias(f"off_{d}") for d in dims]
        apart = cells
        for d in dims:
            apart = apart.withColumn(f"off_{d}", F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"t_{d}")))
        gap = max((x or 0.0) for x in apart.agg(*off).first())
        if gap < CLOSE:
            break
    else:
        warnings.warn(f"raking ended after {SWEEPS} sweeps: margins miss their targets by up to {gap:.6f}", stacklevel=2)
    return cells.select(*dims, "tokens", "docs", F.when(F.col("own") > 0, F.col("w") / F.col("own")).otherwise(1.0).alias("factor")), few


def _scale(cells: DataFrame, budget: float) -> float:
    """c such that the sum of tokens * min(1, c * factor) is budget times all tokens."""
    if budget >= 1:
        return float("inf")
    least = cells.where("tokens > 0 and factor > 0").agg(F.max("factor"), F.min("factor")).first()
    if least[0] is None:
        return float("inf")
    low, high = 0.0, 1 / least[1]
    for _ in range(6):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        sums = cells.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * c)) for c in grid)).first()
        want = budget * sums[0]
        i = next((i for i, x in enumerate(sums[1:]) if x >= want), 32)
        low, high = grid[max(i - 1, 0)], grid[i]
    return high


def _filled(cells: DataFrame, dim: str, want: float) -> float:
    """l such that the sum over values of min(own tokens, l * raked tokens) is `want`."""
    values = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("own"), F.sum(F.col("tokens") * F.col("factor")).alias("aim"))
    level, full = 0.0, -1
    while True:
        whole = F.col("own") <= F.col("aim") * level
        n, kept, free = values.agg(F.sum(F.when(whole, 1).otherwise(0)), F.sum(F.when(whole, F.col("own")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("aim")))).first()
        if n == full or not free:
            return level
        full, level = n, max(level, (want - kept) / free)


def bound(work: Workspace, cells: DataFrame, dims: list[str], budget: float, few: bool) -> DataFrame:
    """`cells` with `p`, probabilities of at most 1 whose expected tokens have the
    margins that `factor` has, as far as there are tokens for them."""
    c = _scale(cells, budget)
    if c == float("inf"):
        return cells.withColumn("p", F.lit(1.0))
    total = float(cells.agg(F.sum("tokens")).first()[0])
    levels = {d: _filled(cells, d, budget * total) for d in dims}
    cells = cells.withColumn("u", F.col("factor") * c)
    for d in dims:
        over = Window.partitionBy(d)
        cells = cells.withColumn(f"t_{d}", F.least(F.sum("tokens").over(over).cast("double"), F.sum(F.col("tokens") * F.col("factor")).over(over) * levels[d]))
    gap = None
    for _ in range(BOUND_SWEEPS // BLOCK):
        if few:
            cells = cells.repartition(1).sortWithinPartitions(*dims)
        for _ in range(BLOCK):
            for d in dims:
                over, aim = Window.partitionBy(d), F.col(f"t_{d}")
                cells = cells.withColumns({"capped": F.sum(F.when(F.col("u") >= 1, F.col("tokens")).otherwise(0)).over(over).cast("double"), "free": F.sum(F.when(F.col("u") < 1, F.col("tokens") * F.col("u")).otherwise(0.0)).over(over)})
                # capped cells stay, free ones fill the rest; where capped ones are too many already, all shrink
                step = F.when((F.col("capped") < aim) & (F.col("free") > 0), (aim - F.col("capped")) / F.col("free")).when(F.col("capped") > aim, aim / (F.col("capped") + F.col("free"))).otherwise(1.0)
                cells = cells.withColumn("u", F.col("u") * step)
        cells = work.table(cells.drop("capped", "free"), "bounded")
        kept = F.col("tokens") * F.least(F.lit(1.0), F.col("u"))
        apart = cells
        for d in dims:
            apart = apart.withColumn(f"off_{d}", F.abs(F.sum(kept).over(Window.partitionBy(d)) - F.col(f"t_{d}")))
        before, gap = gap, max((x or 0.0) for x in apart.agg(*(F.max(f"off_{d}") for d in dims)).first()) / total
        if gap < BOUND_CLOSE or before is not None and gap > 0.999 * before:
            break
    if gap >= BOUND_CLOSE:
        warnings.warn(f"margins of the sample miss their targets by up to {gap:.6f} of all tokens", stacklevel=2)
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("u")))


def uniform(id_: Column, seed: int) -> Column:
    """A number in [0, 1) by the MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = 0.7, budget: float = 0.7, seed: int = 17, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The kept rows of `docs` with topic, n_tokens, weight (the cell's factor)
    and p_include, and the names that these columns got."""
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    names = {c: fresh(c, docs.columns) for c in ("topic", "n_tokens", "weight", "p_include", "_source", "_lang")}
    keys = {"_source": source_col, "_lang": lang_col}
    rows = docs.withColumns({names[k]: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in keys.items()} | {names["topic"]: topic_of(F.col(text_col)) if topic is None else topic})
    dims = [names["_source"], names["_lang"], names["topic"]]
    counted = rows.groupBy(*dims).agg(F.sum(token_count(F.col(text_col))).alias("tokens"), F.count("*").alias("docs"))
    given = {dims[i]: (targets or {})[d] for i, d in enumerate(("source", "lang", "topic")) if d in (targets or {})}
    cells, few = rake(work, counted, dims, temper, given)
    cells = bound(work, cells, dims, budget, few)
    plan = cells.select(*dims, F.col("factor").alias(names["weight"]), F.when(F.col("tokens") > 0, F.col("p")).otherwise(1.0).alias(names["p_include"]))
    kept = rows.join(F.broadcast(plan) if few else plan, dims).where(uniform(F.col(id_col), seed) < F.col(names["p_include"]))
    kept = kept.withColumn(names["n_tokens"], token_count(F.col(text_col)))
    return kept.select(*docs.columns, *(names[x] for x in ("topic", "n_tokens", "weight", "p_include"))), names
