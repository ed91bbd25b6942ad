"""An extension: maps built as GeoJSON files drop into a folder.

Each micro-batch is a set of new files; every file is a map of its own, built by the batch plan. The checkpoint
makes a restart go on where it stopped, and a file built twice overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..options import Options
from ..plans import model
from ..sources import geojson


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[str, model.Model], None], options: Options = Options(), available_now: bool = False) -> StreamingQuery:
    """Build every file that appears in folder and hand (path, model) to sink."""

    def build(batch: DataFrame, number: int) -> None:
        for (path,) in batch.select("path").distinct().toLocalIterator():  # a row for each file
            one = batch.where(F.col("path") == path).select("fc.*")
            sink(path, model.build(geojson.features(one), geojson.meta(one), options))

    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    parsed = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema.GEOJSON).alias("fc"))
    writer = parsed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(build)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
