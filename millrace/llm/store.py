"""Shared folder for tables that cut lineage.

The folder is the one that the session names in ``spark.checkpoint.dir``; only
where that is unset in a local session (tests) a temporary folder is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table that one task writes.
FILE_ROWS = 200_000

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local[app]


#: With it, the shuffle files of a write go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables of one operator call, under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write `df` and read it back: later reads survive lost executors.

        Where at most so many `rows` of a few numbers are known to come, there is
        one task and file for each `FILE_ROWS` of them.
        """
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        self._n += 1
        path = f"{self.base}/{self._n:03d}_{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df, path in [x for x in self._paths if any(x[0] is t for t in tables)]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            self._paths = [x for x in self._paths if x[0] is not df]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
