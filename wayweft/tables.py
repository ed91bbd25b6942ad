"""Intermediate tables in the shared folder spark.checkpoint.dir names: lineage is cut, lost executors do no harm."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of the session's own, deleted at its end; on one machine (a local master) it may be a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/wayweft-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once as Parquet and read back. by: a column of few values, each in files of its own."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
