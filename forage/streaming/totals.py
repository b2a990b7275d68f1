"""Running daily nutrition totals as a streaming aggregate.

The state store holds the sums of each user's day until the watermark has
passed the end of that day by the allowed delay; from the next batch on the day
is closed, and its state is dropped.  Entries of a closed day do not count: the delay says how
late an entry may come, and the stream's progress reports how many came later
(``numRowsDroppedByWatermark``).  Every batch writes the days it changed to a
folded log, and the last row of a day is its total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forage.operators.diary import KEYS, TOTALS
from forage.streaming import folded

#: Days of state: the calendar day of an entry's own date, by its time of making.
DAYS = [*KEYS, "day"]


def start_totals(log: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Keep totals of a diary stream; ``created_at`` is the event time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folded.write_batch(batch, path, batch_id)

    timed = log.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", delay)
    sums = timed.groupBy(*KEYS, F.window("_at", "1 day").alias("day")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(t) for t, c in TOTALS.items()])
    return (
        sums.select(*KEYS, F.col("day.start").alias("day"), *TOTALS)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """Totals per user and date; None before the first batch."""
    days = folded.current(spark, path, DAYS, [])
    return None if days is None else days.groupBy(*KEYS).agg(*[F.sum(t).alias(t) for t in TOTALS])


def fold_totals(spark: SparkSession, path: str, stopped: bool = False) -> None:
    """Merge finished batches into the base and delete what no kept version reads."""
    folded.fold(spark, path, DAYS, [], stopped)
    folded.retire(spark, path)
