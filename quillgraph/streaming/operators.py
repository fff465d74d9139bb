"""Unbounded inputs: bounded reading, enrichment, keyed de-duplication."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators.fixpoint import shared_path
from quillgraph.operators.joins import bind_flatten


def take(stream: DataFrame, n: int, seconds: float = 60.0, checkpoint: str | None = None) -> list:
    """The first n rows of an endless stream; the query is stopped as soon as they are there."""
    held: list = []
    enough = threading.Event()

    def keep(batch: DataFrame, _: int) -> None:
        if len(held) < n:
            held.extend(batch.limit(n - len(held)).collect())
        if len(held) >= n:
            enough.set()

    writer = stream.writeStream.foreachBatch(keep)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        enough.wait(seconds)
    finally:
        query.stop()
    return held


def enrich(stream: DataFrame, table: DataFrame, bindings: dict[str, str]) -> DataFrame:
    """A stream joined to a table; unmatched rows stay, and each micro-batch is visible before the stream ends."""
    return bind_flatten(stream, table, bindings, "left", keys=False)


def first_of_key(stream: DataFrame, key: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time, state older than the delay is dropped."""
    if event_time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def drain(stream: DataFrame, name: str, output: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All rows that are available now, as a table and a view `name` (for bounded inputs).

    Appended rows are written by the tasks below the session's checkpoint folder and never gathered by the driver; a batch that is run
    again is counted once. Other output modes replace rows, so only their final, aggregated ones are held by the driver.
    """
    spark: SparkSession = stream.sparkSession
    base = shared_path(spark, "drained")
    writer = stream.writeStream.outputMode(output).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{base}/checkpoint")
    if output != "append":
        writer.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    writer.format("parquet").queryName(name).start(f"{base}/rows").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{base}/rows")
    found.createOrReplaceTempView(name)
    return found


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Append work(batch) to a folder for all available rows; a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
