"""A stream of measurements as expression tables: windows of event time become time points.

This goes beyond the batch operators: ``windowed`` is a watermarked tumbling aggregation in append mode, and ``ingest`` hands each batch of closed windows to
a function, e.g. one that appends to a table and runs the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, gene: str, replicate: str, time: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """gene_id, rep, start, value: sums of each window; rows later than ``late`` behind the newest are left out, as the watermark says."""
    rows = stream.select(F.col(gene).cast("string").alias("gene_id"), F.col(replicate).cast("int").alias("rep"), F.col(time).alias("at"), F.col(value).cast("double").alias("value"))
    sums = rows.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "gene_id", "rep").agg(F.sum("value").alias("value"))
    return sums.select("gene_id", "rep", F.col("w.start").alias("start"), "value")


def time_points(windows: DataFrame, origin: str, width_seconds: int) -> DataFrame:
    """Windows (start) as integer time points from an origin."""
    tp = F.floor((F.unix_timestamp("start") - F.unix_timestamp(F.lit(origin).cast("timestamp"))) / width_seconds).cast("int")
    return windows.select("gene_id", "rep", tp.alias("tp"), "value")


def ingest(windows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of closed windows to ``sink``; ``checkpoint`` is a folder that all executors share."""
    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
