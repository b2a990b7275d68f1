"""Underserved-query triggers with a lock per key.

A trigger locks its key for 300 seconds counted from the trigger itself, so
whether an event fires depends on the chain of earlier triggers.  The chain is
resolved without gathering a key: events meet their neighbours inside (key, time
slot) groups one lock wide, and chains are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.functions.text import squish
from forage.operators.topk import top_k
from forage.session import cut

MICROS = 1_000_000


def trigger_key(q: Column, lat: Column, lng: Column) -> Column:
    """First 40 characters of the query without white space around it, with ``_`` for spaces, and the place to 3 decimals."""
    words = F.replace(F.substring(squish(q), 1, 40), F.lit(" "), F.lit("_"))
    place = F.when(lat.isNotNull() & lng.isNotNull(), F.format_string("%.3f,%.3f", lat, lng)).otherwise("nogeo")
    return F.concat(words, F.lit(":"), place)


def is_short() -> Column:
    """First page of a search with text and too few hits."""
    return (F.col("total") < fixed.UNDERSERVED_BELOW) & (F.col("page_offset") == 0) & (F.col("q") != "")


def requests_to_check(log: DataFrame) -> DataFrame:
    """First-page searches with text and too few hits, with their trigger key."""
    return log.filter(is_short()).withColumn("trigger_key", trigger_key(F.col("q"), F.col("lat"), F.col("lng")))


def manual_requests(asked: DataFrame) -> DataFrame:
    """Requests made by hand count as searches without hits, so only the lock can hold them back."""
    return asked.withColumns({"total": F.lit(0).cast("bigint"), "page_offset": F.lit(0)})


def fired(events: DataFrame, key: str = "trigger_key", at: str = "ts", lock_seconds: int = fixed.TRIGGER_LOCK_SECONDS) -> DataFrame:
    """(key, at) of every event that fires: not within the lock of the last one that fired."""
    lock = lock_seconds * MICROS
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    times = events.select(F.col(key).alias("k"), micros.alias("t")).distinct()
    slot = F.floor(F.col("t") / lock)

    ends = times.groupBy("k", slot.alias("slot")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    previous = ends.select("k", (F.col("slot") + 1).alias("slot"), F.col("last").alias("previous_last"))
    # one row per event, and one probe per event at the moment its lock ends
    marks = times.select("k", "t", slot.alias("slot"), F.lit(None).cast("bigint").alias("origin"))
    probes = times.select("k", (F.col("t") + lock).alias("t"), (slot + 1).alias("slot"), F.col("t").alias("origin"))
    in_slot = Window.partitionBy("k", "slot").orderBy("t", F.col("origin").isNotNull())
    event_time = F.when(F.col("origin").isNull(), F.col("t"))
    near = marks.unionByName(probes).select(
        "k", "slot", "t", "origin",
        F.max(event_time).over(in_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        # backwards in time the frame only grows, so it is kept up in one pass;
        # by range: an event at exactly the end of the lock may fire
        F.min(event_time)
        .over(Window.partitionBy("k", "slot").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("after"),
    )
    near = near.persist()
    before = (
        near.filter(F.col("origin").isNull())
        .join(previous, ["k", "slot"], "left")
        .select("k", "t", F.coalesce("before", "previous_last").alias("before"))
    )
    is_start = F.col("before").isNull() | (F.col("t") - F.col("before") >= lock)
    starts = cut(before.filter(is_start).select("k", "t"), "chain-starts")
    following = ends.select("k", (F.col("slot") - 1).alias("slot"), F.col("first").alias("next_first"))
    jumps = (
        near.filter(F.col("origin").isNotNull())
        .join(following, ["k", "slot"], "left")
        .select("k", F.col("origin").alias("t"), F.coalesce("after", "next_first").alias("to"))
        .filter(F.col("to").isNotNull())
    )
    # a chain ends where the next event starts a chain of its own
    jumps = cut(jumps.join(starts.withColumnRenamed("t", "to"), ["k", "to"], "left_anti").select("k", "t", "to"), "jumps")
    near.unpersist()
    reached = follow(starts, jumps)
    return reached.select(F.col("k").alias(key), F.timestamp_micros("t").cast(events.schema[at].dataType).alias(at))


def with_triggers(log: DataFrame, lock_seconds: int = fixed.TRIGGER_LOCK_SECONDS) -> DataFrame:
    """The search log with ``underserved``, and ``triggered``: underserved and not held back by the lock of its key."""
    short = requests_to_check(log)
    when = fired(short, lock_seconds=lock_seconds).withColumn("_fired", F.lit(True))
    key = trigger_key(F.col("q"), F.col("lat"), F.col("lng"))
    marked = log.withColumns({"underserved": F.coalesce(is_short(), F.lit(False)), "trigger_key": key}).join(when, ["trigger_key", "ts"], "left")
    return marked.withColumn("triggered", F.col("underserved") & F.col("_fired").isNotNull()).drop("_fired").select(*log.columns, "underserved", "triggered")


def follow(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """All (k, t) reachable from the starts; each round doubles the length of the jumps."""
    reached = starts
    while not jumps.isEmpty():
        landed = reached.join(jumps, ["k", "t"]).select("k", F.col("to").alias("t"))
        reached = cut(reached.unionByName(landed).distinct(), "reached")
        onward = jumps.select("k", F.col("t").alias("to"), F.col("to").alias("far"))
        jumps = cut(jumps.join(onward, ["k", "to"]).select("k", "t", F.col("far").alias("to")), "jumps")
    return reached


def ingest_cap(documents: DataFrame, key: str, order: list[Column], spread_by: str, cap: int = fixed.TRIGGER_INGEST_CAP) -> DataFrame:
    """At most ``cap`` fetched documents per trigger."""
    return top_k(documents, [key], order, cap, spread_by)
