"""PII: information-theoretic sanitisation.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers, found by fixed patterns (leftmost, not overlapping, per kind; an IP's
parts are at most 255, a card has 14 to 19 digits that pass Luhn, a phone 10 to
15 digits; failing matches are dropped).

Beyond them a term is a risk if it tells which entity a text speaks of. The
corpus gives, for a term t and an entity e, the point-wise mutual information
``log2(p(t, e) / (p(t) p(e)))`` over whole texts, and the entity's information
``-log2 p(e)``.
Terms with ``PMI >= DISCLOSURE * information`` and at least `SUPPORT` different
texts that they share with e disclose e: wherever they stand in texts that hold
e they are generalised to their kind (a number, a term). All counts are over all
texts.

DataFrame and SQL code only. Term counts are pre-aggregated; entities of fewer
than `SUPPORT` different texts can have no disclosing term, so only texts that
hold another are read for pairs, once per text; entities that stand in the same
texts have the same terms and are one class. An entity that a third of all texts
hold is a row per text with partial sums, never a list in one task.

Edge cases: a null text is empty; repeated rows get the same result each; a
null id is an id like another; a very long text is read whole, in time that grows
with its length and its matches; an empty table gives an empty result; extra
columns are ignored (or kept by `sanitise`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import found, replaced
from .store import Workspace
from .words import fresh

# The kinds in the order in which spans with one start are listed,
# and their patterns. Possessive forms and the look-behinds match the same
# strings as the plain patterns, without backtracking over long runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

WORD = r"[\p{L}\p{N}]++"
#: Most disclosing terms that are broadcast to their texts; more are joined by shuffle.
FEW_TERMS = 200_000
SUPPORT = 2
DISCLOSURE = 0.8


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, r"[^0-9]", ""), ""))
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(F.regexp_replace(match, r"[^0-9]", ""))
    if kind == "ip":
        return match.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$")
    if kind == "card":
        return F.when((n < 14) | (n > 19), False).otherwise(_luhn(match))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    spans = F.filter(found(text, KINDS[kind]), lambda x: _valid(kind, x["value"]))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value), ordered."""
    text = F.coalesce(text, F.lit(""))

    def listed(rank: int, kind: str) -> Column:
        return F.transform(_spans(kind, text), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

    parts = [listed(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def _terms(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def places(held: DataFrame, risky: DataFrame, base: DataFrame) -> DataFrame:
    """(h, marked): where texts have their disclosing terms outside base spans, as an
    array of (start, end, term) in order. `risky` has the terms (h, term) of texts.

    Places are rows; a running maximum over a text's rows tells what overlaps.
    """
    few = risky.select("h").distinct()
    words = held.join(few, "h", "left_semi").select("h", F.explode(found(F.col("text"), WORD)).alias("x")).select("h", "x.start", "x.end", F.lower("x.value").alias("term"))
    terms = words.join(risky, ["h", "term"], "left_semi").select("h", "start", "end", "term")
    spans = base.join(few, "h", "left_semi").groupBy("h").agg(F.first("spans").alias("spans")).select("h", F.explode("spans").alias("s")).select("h", "s.start", "s.end", F.lit(None).cast("string").alias("term"))
    up, down = Window.partitionBy("h").orderBy("start"), Window.partitionBy("h").orderBy(F.desc("start"))
    span = F.col("term").isNull()
    rows = terms.union(spans).withColumns({"before": F.max(F.when(span, F.col("end"))).over(up), "after": F.min(F.when(span, F.col("start"))).over(down)})
    free = rows.where("term is not null and coalesce(before, 0) <= start and (after is null or after >= end)")
    return free.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term"))).alias("marked"))


def sensitive_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, spans, terms): base spans and the method's own, h the text's hash.

    spans: array of (start, rank, end, kind, value); terms: array of (start, end,
    term), ordered, without overlap with base spans.
    """
    work = Workspace(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    base = work.table(base.select("id", "h", "spans"), "spans")
    shared = work.table(shared_classes(base), "classes")
    holders = shared.select("h").distinct()
    few = holders.count() <= FEW_TERMS
    # the texts that hold a shared entity, once each
    held = docs.select(text_hash(text_col).alias("h"), text.alias("text")).join(F.broadcast(holders) if few else holders, "h", "left_semi")
    held = work.table(held.groupBy("h").agg(F.first("text").alias("text")), "held")
    risky = disclosures(docs.select(text.alias("text")), base.count(), shared, held)
    by_text = work.table(shared.join(risky.select("class", "term"), "class").select("h", "term").distinct(), "risky")
    marked = work.table(places(held, by_text, base), "marked")
    few = (marked.agg(F.sum(F.size("marked"))).first()[0] or 0) <= FEW_TERMS
    out = base.join(F.broadcast(marked) if few else marked, "h", "left")
    none = "cast(array() as array<struct<start:int,end:int,term:string>>)"
    return out.select("id", "h", "spans", F.coalesce("marked", F.expr(none)).alias("terms"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def shared_classes(base: DataFrame) -> DataFrame:
    """(h, class, n, n_value): entities that at least `SUPPORT` different texts
    hold, one (the smallest) for all that stand in the same texts; n is the rows
    of text h, n_value those of all of the entity's texts."""
    by_text = base.where("size(spans) > 0").select("h", F.explode(F.array_distinct(F.col("spans.value"))).alias("value")).groupBy("value", "h").agg(F.count("*").alias("n"))
    prints = [F.bit_xor(F.xxhash64("h", F.lit(i))).alias(f"x{i}") for i in range(2)]
    values = by_text.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("support"), *prints).where(F.col("support") >= SUPPORT)
    classes = values.groupBy("support", "x0", "x1").agg(F.min("value").alias("value"), F.first("n_value").alias("n_value"))
    return by_text.join(classes.select("value", "n_value"), "value").select("h", F.col("value").alias("class"), "n", "n_value")


def disclosures(texts: DataFrame, n_texts: int, shared: DataFrame, held: DataFrame) -> DataFrame:
    """(class, term, disclosure) of terms that disclose a class of entities.

    `texts` holds all texts, `shared` the classes by text, `held` those texts.
    """
    pairs = shared.join(held.select("h", _terms(F.col("text")).alias("words")), "h").select("class", "n", "n_value", F.explode("words").alias("term"))
    pairs = pairs.groupBy("class", "n_value", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    words = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    out = pairs.join(words, "term")
    total = F.lit(float(n_texts))
    info = F.log2(total / F.col("n_value"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_value")))
    return out.where(info > 0).select("class", "term", (pmi / info).alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_email, n_ip, n_card, n_phone, base_sha256, spans (all as kind:start:end)."""
    rows = sensitive_spans(docs, id_col, text_col)
    listed = "transform({0}, s -> concat_ws(':', s.kind, s.start, s.end))"
    both = f"transform(array_sort(concat(transform(spans, s -> struct(s.start, s.rank, s.end, s.kind)), transform(terms, t -> struct(t.start, {len(KINDS)} as rank, t.end, 'term' as kind)))), s -> concat_ws(':', s.kind, s.start, s.end))"
    return rows.select(
        F.col("id").alias(id_col),
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.expr(listed.format("spans")), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(both), ",").alias("spans"),
        F.expr("cast(size(terms) as long)").alias("n_terms"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with base spans and disclosing terms generalised to `[KIND]` in the text."""
    work = Workspace(docs.sparkSession, "sanitise")
    names = {c: fresh(c, docs.columns) for c in ("_id", "_h", "_terms", "_spans", "_cuts")}
    rows = sensitive_spans(docs, id_col, text_col).where("size(terms) > 0").groupBy("id", "h").agg(F.first("terms").alias("terms"))
    rows = work.table(rows.select(F.col("id").alias(names["_id"]), F.col("h").alias(names["_h"]), F.col("terms").alias(names["_terms"])), "terms")
    # base spans are found again in the row; only rows with disclosing terms are joined
    few = (rows.agg(F.sum(F.size(names["_terms"]))).first()[0] or 0) <= FEW_TERMS
    joined = docs.join(F.broadcast(rows) if few else rows, F.col(id_col).eqNullSafe(F.col(names["_id"])) & (text_hash(text_col) == F.col(names["_h"])), "left")
    spans = F.transform(base_spans(F.col(text_col)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("tag")))
    terms = F.transform(F.coalesce(F.col(names["_terms"]), F.expr("cast(array() as array<struct<start:int,end:int,term:string>>)")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["term"].rlike("^[0-9]+$"), "NUMBER").otherwise("TERM").alias("tag")))
    joined = joined.withColumn(names["_cuts"], F.array_sort(F.concat(spans, terms)))
    text, cuts = F.col(text_col), F.col(names["_cuts"])
    clean = F.when(F.coalesce(F.size(cuts), F.lit(0)) == 0, text).otherwise(replaced(text, cuts))
    return joined.withColumn(text_col, clean).select(*docs.columns)
