"""Append-only feedback stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_feedback(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to a table of files."""
    return (
        feedback.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
