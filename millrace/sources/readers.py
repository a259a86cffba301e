"""Sources behind one interface, for streams and batches.

Each reader returns a DataFrame; with `stream=True` a streaming one. Kafka,
JDBC and socket readers need their connectors and servers; file and in-memory
twins of the same shape serve tests and replays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import rename_camel


def kafka_strings(spark: SparkSession, servers: str, topic: str, group: str | None = None, offsets: str = "latest", stream: bool = True) -> DataFrame:
    """(key, value, timestamp) of a topic as strings; a tombstone's value is null."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if stream:
        reader = reader.option("startingOffsets", offsets)
    if group:
        reader = reader.option("groupIdPrefix", group)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: str, **options) -> DataFrame:
    """A topic's JSON values as columns of `schema`."""
    rows = kafka_strings(spark, servers, topic, **options).where("value is not null")
    return rows.select(F.from_json("value", schema).alias("v")).select("v.*")


def text_lines(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 1) -> DataFrame:
    """(value) per line of text files: the file twin of a string topic."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path) if stream else spark.read.text(path)


def table_files(spark: SparkSession, path: str, schema: str | None = None, stream: bool = False, files_per_batch: int = 1) -> DataFrame:
    """Parquet files: the twin of a typed topic, and the scan of a result table."""
    if not stream:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rates(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """(timestamp, value) at a fixed rate, for soak tests."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def jdbc_rows(spark: SparkSession, url: str, query: str, camel: bool = False, **options: str) -> DataFrame:
    """A database query's rows, with camelCase names if asked for."""
    out = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return rename_camel(out) if camel else out


def socket_csv(spark: SparkSession, host: str, port: int, columns: str) -> DataFrame:
    """Comma-separated lines of a socket as typed columns."""
    lines = spark.readStream.format("socket").options(host=host, port=port).load()
    return csv_columns(lines, columns)


def csv_columns(lines: DataFrame, columns: str, value: str = "value") -> DataFrame:
    """Comma-separated text as typed columns, given as a DDL list."""
    parts = F.split(F.col(value), ",")
    fields = [x.strip().rsplit(" ", 1) for x in columns.split(",")]
    return lines.select(*(F.trim(parts[i]).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def elements(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """In-memory rows."""
    return spark.createDataFrame(list(rows), schema)


def point_lookup(dim: DataFrame, key_col: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension by key, all keys at once; a missing key gives nulls."""
    return keys.join(dim.withColumnRenamed(key_col, key), key, "left")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A dimension folder as it is now; read it anew in each micro-batch to see changes."""
    return spark.read.parquet(path)
