"""The rules on streams: scoring is narrow, so the same expressions serve both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseplane.operators import rules


def scored_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """A streaming frame of documents with their scores, without state."""
    return rules.scored(stream, text)


def windowed_levels(stream: DataFrame, ts: str = "ts", text: str = "text", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, level, n, mean_total) of scored documents; rows later than `late` are left out."""
    scored = rules.scored(stream.withWatermark(ts, late), text)
    return scored.groupBy(F.window(ts, window), "level").agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"))


def score_to(stream: DataFrame, path: str, checkpoint: str, text: str = "text"):
    """Writes scores of new documents as Parquet, exactly once, and stops when there are no more."""
    return scored_stream(stream, text).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
