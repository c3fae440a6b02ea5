"""Structured Streaming: watched files, debounced changes, open documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 100, **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def debounced(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """(key, changes, first_ts, last_ts) of bursts of changes (key, ts) with no pause of ``quiet``.

    Works on batches and streams.  On a stream, a burst is given out once,
    when the watermark has passed its end; rows later than ``late`` are left out.
    """
    source = changes.withWatermark("ts", late) if changes.isStreaming else changes
    bursts = source.groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return bursts.select("key", "changes", "first_ts", "last_ts")


def latest(documents: DataFrame) -> DataFrame:
    """(uri, version, text): the last version of each open document; on a stream the state is one row a document."""
    last = documents.groupBy("uri").agg(F.max_by(F.struct("version", "text"), "version").alias("d"))
    return last.select("uri", "d.version", "d.text")


def reanalyse(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Runs an analysis over each micro-batch and appends its findings; a batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
