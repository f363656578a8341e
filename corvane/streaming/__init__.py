"""Streaming forms of the count operators: the same expressions over an unbounded table.

Counts of words and of Markov transitions are sums, so a stream updates them batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(stream: DataFrame, words: str) -> DataFrame:
    """Running counts, for an update or complete sink."""
    return stream.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window; rows later than ``late`` are left out and state is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to ``use``, for operators that fit from sums."""
    return stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).start()
