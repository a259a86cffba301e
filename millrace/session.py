"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Warehouse jobs run at +08:00; fixtures and oracles at UTC.
WAREHOUSE_ZONE = "Asia/Shanghai"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "millrace", zone: str = "UTC", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, a fixed zone and RocksDB state."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {"spark.sql.session.timeZone": zone} | extra)
    return (builder.master(master) if master else builder).getOrCreate()
