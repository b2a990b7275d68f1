"""A refresh plan that fires its pairs of city and keyword at their interval, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from forage.functions import fixed
from forage.session import keyed_state

_DUE = "refresh_key string, city string, keyword string, due long"


class Timetable(StatefulProcessor):
    """Each key holds its next time and a timer at it; the rows that drive the clock carry nothing."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "due long, city string, keyword string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        pair = initialState.iloc[0]
        self.next.update((int(pair["due"]), pair["city"], pair["keyword"]))
        self.handle.registerTimer(int(pair["due"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, city, keyword = self.next.get()
        # A clock that jumps over several intervals fires each of them.
        times = range(due, max(timerValues.getCurrentWatermarkInMs(), due + 1), self.interval)
        self.next.update((times[-1] + self.interval, city, keyword))
        self.handle.registerTimer(times[-1] + self.interval)
        yield pd.DataFrame([(key[0], city, keyword, t) for t in times], columns=["refresh_key", "city", "keyword", "due"])

    def close(self) -> None:
        pass


def pairs(spark: SparkSession, cities: list[str] = fixed.REFRESH_CITIES, keywords: list[str] = fixed.REFRESH_KEYWORDS) -> DataFrame:
    """Every city with every keyword."""
    return spark.createDataFrame([(c, w) for c in cities for w in keywords], "city string, keyword string")


def _latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([pc.max(batch.column(0)).as_py()], type=batch.column(0).type)], names=["at"])


def refresh_plan(
    clock: DataFrame, plan: DataFrame, start, at: str = "ts", delay: str = "10 minutes",
    first_seconds: int = fixed.REFRESH_FIRST_SECONDS, interval_seconds: int = fixed.REFRESH_INTERVAL_SECONDS,
) -> DataFrame:
    """(refresh_key, city, keyword, ts) of each run of each pair in ``plan``.

    ``clock`` is any stream with event times in ``at``; time passes as its
    watermark does.  The first run comes ``first_seconds`` after ``start``,
    then one every interval.  Of the clock one row per Arrow batch is kept, so
    the plan costs one small state row per pair whatever the stream's size.
    """
    keyed_state(plan.sparkSession)
    # the latest time of each Arrow batch, so that the clock shuffles next to nothing
    ticks = clock.select(F.col(at).cast("timestamp").alias("at")).mapInArrow(_latest, "at timestamp")
    ticks = ticks.withWatermark("at", delay).withColumn("refresh_key", F.lit("clock"))
    due = F.unix_millis(F.lit(start).cast("timestamp")) + 1000 * first_seconds
    key = F.concat_ws("|", "city", "keyword").alias("refresh_key")
    first = plan.select(key, "city", "keyword", due.alias("due")).distinct()
    runs = ticks.groupBy("refresh_key").transformWithStateInPandas(Timetable(1000 * interval_seconds), _DUE, "append", "EventTime", initialState=first.groupBy("refresh_key"))
    return runs.select("refresh_key", "city", "keyword", F.timestamp_millis("due").alias("ts"))
