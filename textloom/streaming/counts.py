"""Incremental forms of the batch operators over streams of documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import tokens


def stream_term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, count) kept up to date; batches merge by partial sums, as in the batch operator."""
    return docs.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def stream_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and time window; windows close once the watermark has passed them."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def stream_first_seen(docs: DataFrame, key: str = "text_hash", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first document of each checksum within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
