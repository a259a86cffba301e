"""Places of pattern matches in texts as native column expressions, in time that
grows with the text.

Spark gives all matches and all pieces between them, by one and the same matcher;
a running sum of their lengths turns them into places. Sums over arrays are made
in blocks of `BLOCK`: a list grown one by one is copied each time, so lists are
grown within a block only, and blocks are put together once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Code points of the pieces that a text is cut into before substrings are taken.
PIECE, LARGE = 2_048, 131_072


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _blocks(items: Column, scan: Callable[[Column], Column]) -> Column:
    """scan of each block of BLOCK items."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: scan(F.slice(items, b * BLOCK + 1, BLOCK)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (gap, from, start, end, value, head): each match's value (a group that
    ends with the match) at [start, end), the match before it, and the text before
    that, which begins at `from`; the last item is the rest of the text, without a value."""
    parts = [F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    kind = "array<struct<gap:string,from:int,start:int,end:int,value:string,head:string>>"

    def step(s: Column, x: Column) -> Column:
        head = F.length(x["g"])
        end = s["at"] + head + F.coalesce(F.length(x["m"]), F.lit(0))
        value = x["v"] if group else x["m"]
        before = F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(value)) if group else F.lit("")
        item = F.struct(x["g"].alias("gap"), s["at"].alias("from"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), before.alias("head"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    def scan(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

    def joined(blocks: Column) -> Column:
        base = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        moved = lambda i, o: F.struct(i["gap"].alias("gap"), (i["from"] + o).alias("from"), (i["start"] + o).alias("start"), (i["end"] + o).alias("end"), i["value"].alias("value"), i["head"].alias("head"))
        return F.flatten(F.zip_with(blocks, base, lambda b, o: F.transform(b["out"], lambda i: moved(i, o))))

    return let(F.arrays_zip(*parts), lambda items: let(_blocks(items, scan), joined))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points."""
    hits = F.filter(matches(text, pattern), lambda x: x["value"].isNotNull())
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def replaced(text: Column, cuts: Column) -> Column:
    """The text with `[TAG]` for each of its cuts (start, end, tag), which come in
    order; what several cuts hold goes once, and a cut within another gives no tag."""
    kind = "array<struct<start:int,end:int,tag:string,at:int>>"

    def step(s: Column, x: Column) -> Column:
        item = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("tag"), s["at"].alias("at"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    def scan(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

    def joined(blocks: Column) -> Column:
        # `at` is the furthest end of the cuts before; a block's own begins at 0
        base = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, b: F.struct(F.greatest(s["at"], b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        moved = lambda i, o: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["tag"].alias("tag"), F.greatest(i["at"], o).alias("at"))
        return F.flatten(F.zip_with(blocks, base, lambda b, o: F.transform(b["out"], lambda i: moved(i, o))))

    def cut_up(whole: Column) -> Column:
        inner = lambda large: F.transform(F.sequence(F.lit(0), F.lit(LARGE // PIECE - 1)), lambda p: F.substring(large, p * PIECE + 1, F.lit(PIECE)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length(whole) / LARGE).cast("int")), lambda n: let(F.substring(whole, n * LARGE + 1, F.lit(LARGE)), inner)))

    def part(pieces: Column, from_: Column, to: Column) -> Column:
        one = lambda p: F.substring(F.get(pieces, p), F.greatest(from_ - p * PIECE, F.lit(0)) + 1, F.least(to, (p + 1) * PIECE) - F.greatest(from_, p * PIECE))
        return F.when(to <= from_, "").otherwise(F.array_join(F.transform(F.sequence(F.floor(from_ / PIECE).cast("int"), F.floor((to - 1) / PIECE).cast("int")), one), ""))

    def written(pieces: Column, kept: Column, n: Column) -> Column:
        body = F.transform(F.filter(kept, lambda x: x["end"] > x["at"]), lambda x: F.concat(part(pieces, x["at"], x["start"]), F.lit("["), x["tag"], F.lit("]")))
        last = F.element_at(kept, -1)
        return F.concat(F.array_join(body, ""), part(pieces, F.greatest(last["at"], last["end"]), n))

    return let(text, lambda t: let(cut_up(t), lambda pieces: let(let(_blocks(cuts, scan), joined), lambda kept: written(pieces, kept, F.length(t)))))
