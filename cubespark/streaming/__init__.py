"""Bounded and unbounded appends to cubes and sample sets by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, partition_by: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch prepared and written to a folder of its own number, so a replay after a failure replaces its rows."""

    def write(df: DataFrame, number: int) -> None:
        out = prepare(df).write.mode("overwrite")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_cells(stream: DataFrame, time: str, every: str, late: str, dims: list[str], values: dict[str, Column]) -> DataFrame:
    """Cube cells of a stream: values by time window and dimension, final once the watermark has passed."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("_w"), *dims)
    return grouped.agg(*[e.alias(n) for n, e in values.items()]).select(F.col("_w.start").alias(time), *dims, *values)
