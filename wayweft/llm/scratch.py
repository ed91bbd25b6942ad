"""Tables written to the shared folder, to cut lineage and to be read more than once.

The folder is the session's spark.checkpoint.dir. Only on one machine (a local master, as in tests) may it be
unset; a folder under the local temp folder serves then. Parquet files survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


class Scope(list):
    """The tables written within a `with scratch.scope()` block."""

    def release(self) -> None:
        """Delete them; no frame built on them may be used afterwards."""
        for one in self:
            _written.remove(one)
            _delete(*one)
        self.clear()


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    own = Scope()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.gettempdir()
    return f"{found.rstrip('/')}/wayweft-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    if (own := _scope.get()) is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written.clear()
