import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from forage.operators import trigger
from forage.session import work_path
from forage.streaming.feedback import start_feedback
from forage.streaming.trigger import stream_triggers

START = dt.datetime(2024, 1, 1)


def greedy(times, lock=300):
    fired, last = [], None
    for t in sorted(set(times)):
        if last is None or t >= last + lock:
            fired.append(t)
            last = t
    return fired


def run(spark, events):
    rows = [(k, START + dt.timedelta(seconds=t)) for k, t in events]
    df = spark.createDataFrame(rows, "trigger_key string, ts timestamp_ntz")
    got = {}
    for r in trigger.fired(df).collect():
        got.setdefault(r["trigger_key"], []).append((r["ts"] - START).total_seconds())
    return {k: sorted(v) for k, v in got.items()}


def test_chain(spark):
    assert run(spark, [("a", t) for t in (0, 100, 299, 300, 650)]) == {"a": [0, 300, 650]}


def test_against_a_walk(spark):
    rng = random.Random(5)
    events = []
    for key, (n, span) in {"dense": (900, 9000), "sparse": (60, 90000), "burst": (200, 700)}.items():
        events += [(key, rng.randrange(span * 10) / 10) for _ in range(n)]
    got = run(spark, events)
    for key in ("dense", "sparse", "burst"):
        assert got[key] == greedy([t for k, t in events if k == key])


def test_key(spark):
    df = spark.createDataFrame([("  a b " + "x" * 50, 39.90049, 116.3), ("q", None, 1.0)], "q string, lat double, lng double")
    got = [r[0] for r in df.select(trigger.trigger_key(F.col("q"), F.col("lat"), F.col("lng"))).collect()]
    assert got == ["a_b_" + "x" * 36 + ":39.900,116.300", "q:nogeo"]


def test_manual_requests_meet_the_same_lock(spark):
    log = spark.createDataFrame([("q", START, 9), ("q", START + dt.timedelta(seconds=50), 0)], "q string, ts timestamp_ntz, total bigint")
    log = log.withColumns({"page_offset": F.lit(0), "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    searched = trigger.fired(trigger.requests_to_check(log)).collect()
    by_hand = trigger.fired(trigger.requests_to_check(trigger.manual_requests(log))).collect()
    assert [r["ts"] for r in searched] == [START + dt.timedelta(seconds=50)] and [r["ts"] for r in by_hand] == [START]


def test_ingest_cap(spark):
    df = spark.range(100).select(F.lit("k").alias("key"), "id")
    kept = trigger.ingest_cap(df, "key", [F.asc("id")], "id")
    assert sorted(r["id"] for r in kept.collect()) == list(range(30))


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, shuffled):
    """Files in any order give the triggers of one batch, once a later event has closed them."""
    rng = random.Random(7)
    rows = sorted(
        (START + dt.timedelta(seconds=rng.randrange(20000)), rng.choice("ab"), rng.randrange(8), 0, None, None) for _ in range(400)
    )
    parts = [rows[i * 100 : (i + 1) * 100] for i in range(4)]
    if shuffled:
        parts = [parts[k] for k in (2, 0, 3, 1)]
    closing = [(START + dt.timedelta(days=3), "later", 0, 0, None, None)]
    schema = "ts timestamp_ntz, q string, total int, page_offset int, lat double, lng double"
    path = work_path(spark, "log")
    for part in [*parts, closing]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = work_path(spark, "fired")
    start_feedback(stream_triggers(log, "1 day"), out, work_path(spark, "state")).awaitTermination()
    live = sorted((r["trigger_key"], r["ts"]) for r in spark.read.parquet(out).collect())
    batch = trigger.fired(trigger.requests_to_check(spark.createDataFrame(rows, schema)))
    assert live == sorted((r["trigger_key"], r["ts"]) for r in batch.collect())


def test_key_without_white_space_around_it(values):
    keys = values(["\t vegan food \n", "x" * 50], trigger.trigger_key(F.col("x"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert keys == ["vegan_food:nogeo", "x" * 40 + ":nogeo"]


def test_many_events_of_one_key_and_slot(spark):
    """A crowded slot costs one pass, not one per event."""
    events = spark.range(40000).select(F.lit("k").alias("trigger_key"), F.timestamp_micros(F.col("id") * 7000).alias("ts"))
    began = time.monotonic()
    assert trigger.fired(events).count() == 1
    assert time.monotonic() - began < 30


def test_searches_of_an_hour_wait_in_one_entry_and_fire_in_order():
    """As many state entries as hours, whatever the number of moments; the watermark takes out what it has passed."""
    import pandas as pd

    from forage.streaming.trigger import ENTRY, Lock

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Entries(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        def __init__(self):
            self.timers, self.entries = set(), Entries()
            self.getValueState, self.getMapState, self.registerTimer = lambda *a: Value(), lambda *a: self.entries, self.timers.add

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    rng = random.Random(3)
    times = [rng.randrange(5 * ENTRY * 1000) for _ in range(3000)]
    handle, lock = Handle(), Lock(300_000_000)
    lock.init(handle)
    want, last = [], None
    for t in sorted(times):
        if last is None or t >= last + 300_000_000:
            want.append(t)
            last = t
    got = []
    for part in (times[1000:], times[:1000]):
        list(lock.handleInputRows(("k",), iter([pd.DataFrame({"t": part, "q": "k", "lat": None, "lng": None})]), None))
    assert len(handle.entries) == 5 and len(handle.timers) <= 10
    for watermark in (ENTRY // 2, 2 * ENTRY, 2 * ENTRY + 7, 9 * ENTRY):
        while due := [ms for ms in handle.timers if ms < watermark]:
            handle.timers.remove(min(due))
            for frame in lock.handleExpiredTimer(("k",), Now(watermark), Now(min(due))):
                got += frame["t"].tolist()
        assert got == [t for t in want if t // 1000 < watermark]
    assert not handle.entries and not lock.last.exists()
