"""Underserved-query triggers on a live search log, with an exact lock per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from forage.functions import fixed
from forage.operators.trigger import MICROS, requests_to_check
from forage.session import keyed_state

FIRED = "trigger_key string, t long, q string, lat double, lng double"


def _order(event: tuple) -> tuple:
    """Events of one moment in a fixed order, null first."""
    return tuple((v is not None, v) for v in event)


#: Milliseconds whose waiting searches of a key are one entry.
ENTRY = 3_600_000


class Lock(StatefulProcessor):
    """Searches of a key in event-time order; one that fires holds the next ones back.

    The searches that wait in one hour are an entry of map state, with a timer
    at the first of them.  A timer that the watermark has passed takes out all
    searches of its hour that the watermark has passed, and leaves one at the
    first that still waits.  The last trigger is forgotten by a timer at the
    end of its lock.
    """

    def __init__(self, lock: int):
        self.lock = lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.waiting = handle.getMapState("waiting", "hour long", "t array<long>, q array<string>, lat array<double>, lng array<double>")

    def _wait(self, hour: int, moments: dict[int, tuple]) -> None:
        times = sorted(moments)
        self.waiting.updateValue((hour,), (times, *([moments[t][k] for t in times] for k in range(3))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, dict[int, tuple]] = {}
        for frame in rows:
            none = frame.astype(object).where(frame.notna(), None)
            for t, *search in zip(none["t"], none["q"], none["lat"], none["lng"]):
                moments = arrived.setdefault(int(t) // 1000 // ENTRY, {})
                moments[int(t)] = min(moments.get(int(t), tuple(search)), tuple(search), key=_order)
        for hour, moments in arrived.items():
            first = None
            if self.waiting.containsKey((hour,)):
                for t, *search in zip(*self.waiting.getValue((hour,))):
                    first = t if first is None else first
                    moments[t] = min(moments.get(t, tuple(search)), tuple(search), key=_order)
            self._wait(hour, moments)
            if first is None or min(moments) // 1000 < first // 1000:
                self.handle.registerTimer(min(moments) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(ms, timerValues.getCurrentWatermarkInMs() - 1)  # searches of later ones may still arrive
        hour = ms // ENTRY
        last = self.last.get()[0] if self.last.exists() else None
        fired, later = [], {}
        if self.waiting.containsKey((hour,)):
            for t, *search in zip(*self.waiting.getValue((hour,))):
                if t // 1000 > passed:
                    later[t] = tuple(search)
                elif last is None or t >= last + self.lock:
                    last = t
                    fired.append((key[0], t, *search))
            if later:
                self._wait(hour, later)
                self.handle.registerTimer(min(later) // 1000)
            else:
                self.waiting.removeKey((hour,))
        if fired:
            self.last.update((last,))
            self.handle.registerTimer((last + self.lock) // 1000)
            yield pd.DataFrame(fired, columns=["trigger_key", "t", "q", "lat", "lng"])
        elif last is not None and (last + self.lock) // 1000 <= ms:
            self.last.clear()

    def close(self) -> None:
        pass


def stream_triggers(log: DataFrame, delay: str = "10 minutes", lock_seconds: int = fixed.TRIGGER_LOCK_SECONDS) -> DataFrame:
    """(trigger_key, ts, q, lat, lng) of each search that fires.

    Whether a search fires depends on earlier ones, so searches wait until the
    watermark has passed them and are then taken in event-time order, whatever
    order they came in.  Searches later than ``delay`` are not considered, and
    the last ``delay`` of a stream waits for searches that close it.  Searches
    of one key at the same microsecond count once.
    """
    keyed_state(log.sparkSession)
    searches = (
        requests_to_check(log)
        .select("trigger_key", F.col("ts").cast("timestamp").alias("at"), "q", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
        .withWatermark("at", delay)
        .withColumn("t", F.unix_micros("at"))
    )
    fired = searches.groupBy("trigger_key").transformWithStateInPandas(Lock(lock_seconds * MICROS), FIRED, "append", "EventTime")
    return fired.select("trigger_key", F.timestamp_micros("t").alias("ts"), "q", "lat", "lng")
