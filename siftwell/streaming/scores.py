"""Scores that arrive as a stream: running means of systems and items still worth annotating.

An extension for online annotation: batches of new judgements update the statistics that the batch operators use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_means(stream: DataFrame, watermark: str | None = None, window: str | None = None, time: str = "ts") -> DataFrame:
    """Mean, count and population variance of each system and metric, overall or in event-time windows that close at the watermark."""
    keys = ["system", "metric"]
    if window:
        stream = stream.withWatermark(time, watermark or "0 seconds")
        keys = [F.window(time, window).alias("window"), *keys]
    return stream.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.var_pop("value").alias("variance"))


def running_utility(stream: DataFrame, metric: str) -> DataFrame:
    """Population variance over systems for each item, as judgements come in."""
    return stream.where(F.col("metric") == metric).groupBy("item_id").agg(F.var_pop("value").alias("utility"), F.count("value").alias("n"))


def into_table(df: DataFrame, name: str, mode: str = "complete"):
    """Runs a stream into an in-memory table until all that is there has been read."""
    running = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    running.processAllAvailable()
    running.stop()
    return df.sparkSession.table(name)
