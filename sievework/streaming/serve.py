"""Streams of files: the serving projection, uploads that come again, a sink that can be written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievework.operators.serve import serving_row


def serve_stream(spark: SparkSession, source: str, schema: T.StructType, logits: str, names: list[str], guidance: DataFrame, files_at_once: int = 100) -> DataFrame:
    """A streaming frame of serving rows of the Parquet files that arrive in a folder; a static lookup, no state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return serving_row(rows, logits, names, guidance)


def start(rows: DataFrame, sink: str, checkpoint: str):
    """Write what has arrived as JSON lines, once for each row, and stop."""
    return rows.select("document").writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def unique_uploads(uploads: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """A streaming frame with each key once: what comes again within `within` of event time is dropped, and state older than that is let go.

    `within` has to cover how late and how long after each other rows may come.
    """
    return uploads.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def start_once(rows: DataFrame, sink: str, checkpoint: str):
    """Write what has arrived to one Parquet folder for each micro-batch, and stop.

    A batch that is run again, after a failure or a restart, has its number and
    writes the same folder anew, so the sink has each row once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sink(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """All rows of start_once."""
    return spark.read.schema(schema).parquet(sink).drop("batch")
