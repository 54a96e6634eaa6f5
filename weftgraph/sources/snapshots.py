"""Snapshots: results written once to a folder that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Names of plan nodes whose result costs more to make again than to read.
COSTLY = ("Aggregate", "Distinct", "Generate", "Join", "Sort", "Window")


def settled(df: DataFrame) -> DataFrame:
    """df for reading again and again: as it is where it only filters and selects from files, else a snapshot."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = {line.lstrip(" :+-!").split(" ", 1)[0].split("(")[0] for line in plan.splitlines()}
    return snapshot(df) if names & set(COSTLY) or "LogicalRDD" in plan or "LocalRelation" in plan else df


def snapshot(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here, and lost executors reread files."""
    path = f"{folder(df.sparkSession)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
