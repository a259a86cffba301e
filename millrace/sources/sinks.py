"""Sinks. Files are written idempotently per micro-batch, so replays don't double rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.strings import bean_json
from ..operators.cdc import merge_rows


def to_kafka(df: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> DataStreamWriter:
    """Values to one topic, or to each row's `topic` column where none is named."""
    out = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return out.option("topic", topic) if topic else out


def keyed(df: DataFrame, key: str, value: str | None = None, order: str | None = None) -> DataFrame:
    """(key, value) for an upsert topic: JSON of the row, or null for deletions (op '-D');
    an `order` column stays beside them."""
    beside = [order] if order else []
    body = F.col(value) if value else bean_json(df, hidden=("op", *beside))
    gone = (F.col("op") == "-D") if "op" in df.columns else F.lit(False)
    return df.select(F.col(key).cast("string").alias("key"), F.when(gone, F.lit(None)).otherwise(body).alias("value"), *beside)


def latest_per_key(messages: DataFrame, order: str) -> DataFrame:
    """What an upsert topic holds: the last value of each key, without tombstones."""
    last = messages.groupBy("key").agg(F.max_by(F.struct("value"), order).alias("m"))
    return last.select("key", F.col("m.value").alias("value")).where("value is not null")


def in_folder(path: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each micro-batch replaces its own sub-folder `batch=<id>`."""

    def write(df: DataFrame, batch: int) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(f"{path}/batch={batch}")

    return write


def append_by_date(df: DataFrame, path: str, date: str = "cur_date", mode: str = "append") -> None:
    """A result table partitioned by day."""
    df.write.mode(mode).partitionBy(date).parquet(path)


def by_topic(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the file twin of a dynamic-topic sink, one folder per topic."""
    return in_folder(path, "topic")


def dimension_merge(path: str, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """foreachBatch: routed changes are merged into the rows of the version before.

    Each micro-batch writes a version named by it, so a replayed batch replaces
    itself; versions before the last go, so work and space follow the rows and the
    batch, not the history.
    """
    keys = ["sink_table", "row_key"]

    def write(df: DataFrame, batch: int) -> None:
        spark, root = df.sparkSession, f"{path}/rows"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        before = sorted(int(x.split("=")[1]) for x in names if x.startswith("version=") and int(x.split("=")[1]) < batch)
        routed = df.persist()
        try:
            rows = merge_rows(routed, order)
            if before:
                gone = routed.where("op = 'delete'").select(*keys).distinct()
                had = spark.read.parquet(f"{root}/version={before[-1]}").join(gone, keys, "left_anti")
                both = had.join(rows.withColumnRenamed("data", "newer"), keys, "full")
                # cells that the batch writes replace those of the row before
                kept = F.map_filter("data", lambda k, _: ~F.map_contains_key(F.coalesce("newer", F.create_map().cast("map<string,string>")), k))
                cells = F.when(F.col("newer").isNull(), F.col("data")).when(F.col("data").isNull(), F.col("newer")).otherwise(F.map_concat(kept, "newer"))
                rows = both.select(*keys, F.map_from_entries(F.array_sort(F.map_entries(cells))).alias("data"))
            rows.write.mode("overwrite").parquet(f"{root}/version={batch}")
        finally:
            routed.unpersist()
        for version in before[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version={version}"), True)

    return write


def dimension_tables(config_changes: DataFrame, drop: Callable[[str], None], create: Callable[[str, str], None]) -> None:
    """Create and drop dimension tables as the configuration says: read and created
    rows make one, deleted ones drop it, updated ones drop and make it anew (its data goes).

    Configuration is small and ordered by ts_ms.
    """
    for r in config_changes.select("op", "sink_table", "sink_family", "ts_ms").orderBy("ts_ms").toLocalIterator():
        if r.op in ("d", "u"):
            drop(r.sink_table)
        if r.op in ("r", "c", "u"):
            create(r.sink_table, r.sink_family)


def to_console(df: DataFrame, rows: int = 20) -> DataStreamWriter:
    return df.writeStream.format("console").option("numRows", rows)
