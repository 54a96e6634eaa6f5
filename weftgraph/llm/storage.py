"""Cutting lineage with written tables that every executor can read."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Drops a query's shuffle files as it ends, where Spark knows the setting.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """A table written under the shared folder, which later reads take instead of its lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/weft/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_UP)
            else:
                self.spark.conf.set(CLEAN_UP, before)
        if scopes := getattr(_open, "scopes", []):
            scopes[-1].append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[Written]]:
    """Tables written inside are dropped at the end, but those put in the list, which the result still reads."""
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    kept: list[Written] = []
    _open.scopes.append([])
    try:
        yield kept
    finally:
        for table in _open.scopes.pop():
            if not any(table is k for k in kept):
                table.drop()
        if _open.scopes:
            _open.scopes[-1].extend(kept)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).read()
