"""Streaming: extraction is stateless per document, so a stream of documents takes the same functions; counts take a watermark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import extract


def stream_mentions(docs: DataFrame) -> DataFrame:
    """Mentions of a stream of (doc_id, text, ...): sentences and patterns, no state."""
    return extract.pattern_mentions(X.sentences(docs, "doc_id"), "doc_id")


def stream_event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per window and type of a stream of (ts, event_type, value), late rows accepted up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes everything available now and stops; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
