"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "wayweft", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WAYWEFT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
