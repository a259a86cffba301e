"""Change records: parsing, gates, routes and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import kept_columns, not_empty
from ..functions.times import from_seconds

CHANGE = "database string, table string, type string, ts bigint, data map<string,string>, old map<string,string>"
CHANGE_TYPES = ("insert", "update", "delete", "bootstrap-insert")


def parse_changes(df: DataFrame, value: str = "value") -> DataFrame:
    """Columns of CHANGE and `et` (event time) from JSON; unreadable records are dropped."""
    x = F.from_json(F.col(value).cast("string"), CHANGE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.where(F.col(value).isNotNull()).select(x.alias("c")).where("c is not null and c._bad is null").select("c.*").drop("_bad").withColumn("et", from_seconds(F.col("ts")))


def bad_records(df: DataFrame, value: str = "value", schema: str = CHANGE) -> DataFrame:
    """The records that parsing drops."""
    x = F.from_json(F.col(value).cast("string"), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.where(F.col(value).isNotNull()).withColumn("_c", x).where("_c is null or _c._bad is not null").drop("_c")


def dimension_gate(df: DataFrame, database: str) -> DataFrame:
    """Changes that dimension routing takes: one database, known types, with data."""
    return df.where((F.col("database") == database) & F.col("type").isin(*CHANGE_TYPES) & (F.coalesce(F.size("data"), F.lit(0)) > 0))


def fact_gate(df: DataFrame) -> DataFrame:
    """Changes that fact routing takes: no bootstrap records, any database."""
    return df.where(~F.col("type").startswith("bootstrap-"))


def of_table(df: DataFrame, table: str, *types: str) -> DataFrame:
    """Changes of one table, of the named types if any."""
    out = df.where(F.col("table") == table)
    return out.where(F.col("type").isin(*types)) if types else out


def data(key: str) -> Column:
    return F.col("data")[key]


def old(key: str) -> Column:
    return F.col("old")[key]


def project(df: DataFrame, keys: list[str], **named: Column) -> DataFrame:
    """Payload keys as columns, further columns by name, and `ts` and `et`."""
    return df.select(*(data(k).alias(k) for k in keys), *(c.alias(k) for k, c in named.items()), "ts", "et")


def became(field: str, value: str) -> Column:
    """The field changed, and now has the value."""
    return old(field).isNotNull() & (data(field) == value)


def went(field: str, before: str, after: str) -> Column:
    """The field changed from one value to another."""
    return (old(field) == before) & (data(field) == after)


def grew(field: str) -> Column:
    """The field changed to a larger whole number."""
    return old(field).isNotNull() & (data(field).cast("int") > old(field).cast("int"))


def config_rows(df: DataFrame, columns: str, value: str = "value") -> DataFrame:
    """Configuration changes: the row before for deletes, after otherwise, with op and ts_ms."""
    x = F.from_json(F.col(value).cast("string"), f"before struct<{columns}>, after struct<{columns}>, op string, ts_ms bigint")
    return df.select(x.alias("c")).select(F.when(F.col("c.op") == "d", F.col("c.before")).otherwise(F.col("c.after")).alias("row"), "c.op", "c.ts_ms").select("row.*", "op", "ts_ms")


def current_config(changes: DataFrame, *keys: str) -> DataFrame:
    """The configuration in force: the last change of each key, without deleted ones."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_ms", "op")).alias("last"))
    return last.where("last.op <> 'd'").select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest if c not in ("op", "ts_ms")))


def route_dimensions(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured tables: sink_table, row_key, op and the kept columns.

    `config` has source_table, sink_table, sink_columns and sink_row_key.
    """
    c = config.select(F.col("source_table").alias("table"), "sink_table", "sink_columns", "sink_row_key")
    joined = changes.join(c, "table")
    return joined.select("sink_table", F.element_at("data", F.col("sink_row_key")).alias("row_key"), F.col("type").alias("op"), kept_columns(F.col("data"), F.col("sink_columns")).alias("data"), "ts")


def route_facts(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured (table, type): topic and the JSON of kept columns and ts."""
    c = config.select(F.col("source_table").alias("table"), F.col("source_type").alias("type"), F.col("sink_table").alias("topic"), "sink_columns")
    joined = changes.join(c, ["table", "type"])
    body = F.map_concat(kept_columns(F.col("data"), F.col("sink_columns")), F.create_map(F.lit("ts"), F.col("ts").cast("string")))
    return joined.select("topic", F.to_json(body).alias("value"), "ts")


def merge_rows(routed: DataFrame, order: str = "seq") -> DataFrame:
    """Dimension rows after all puts and deletes, as (sink_table, row_key, data).

    A put writes its non-empty cells only, a delete removes the row: each cell is
    its last non-empty value since the row's last delete. The maximum of deletes
    and the last of cells are pre-aggregated; a row's changes never meet in one list.
    """
    keys = ["sink_table", "row_key"]
    gone = routed.where("op = 'delete'").groupBy(*keys).agg(F.max(order).alias("gone"))
    cells = routed.where("op <> 'delete'").select(*keys, order, F.explode("data").alias("name", "cell")).where(not_empty(F.col("cell")))
    cells = cells.join(gone, keys, "left").where(F.col("gone").isNull() | (F.col(order) > F.col("gone")))
    last = cells.groupBy(*keys, "name").agg(F.max_by("cell", order).alias("cell"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "cell")))).alias("data"))
