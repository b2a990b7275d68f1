import datetime as dt

import pytest
from pyspark.sql import functions as F

from forage.operators import state

CATALOG = "restaurant_id string, name string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(spark):
    current = spark.createDataFrame([("a", "old"), ("b", "keep")], CATALOG)
    batch = spark.createDataFrame(
        [(1, "a", None, "first"), (2, "a", None, "last"), (3, None, "c", "by id"), (4, "", None, "lost")],
        "seq int, restaurant_id string, _id string, name string",
    )
    merged = state.upsert(current, batch, ["seq"])
    assert rows(merged) == [("a", "last"), ("b", "keep"), ("c", "by id")]
    assert rows(state.upsert(merged, batch, ["seq"])) == rows(merged)
    assert state.upsert_counts(batch).first().asDict() == {"indexed": 3, "rejected": 1}
    with pytest.raises(Exception, match="restaurant_id"):
        state.upsert(current, batch, ["seq"], strict=True).collect()


def test_saved(spark):
    log = spark.createDataFrame(
        [
            (1, 1, "r", "save", 10), (2, 1, "r", "save", 20), (3, 1, "q", "save", 5), (4, 1, "q", "unsave", 6),
            (5, 1, "q", "save", 7), (6, 1, "q", "save", 8), (7, 2, "r", "save", 1), (8, 2, "r", "unsave", 1),
        ],
        "event_id int, user_id int, restaurant_id string, op string, ts int",
    )
    saved = state.saved_state(log, ["ts", "event_id"])
    # a key that was never unsaved is kept as well
    assert rows(saved) == [(1, "q", 7), (1, "r", 10)]
    assert [r["restaurant_id"] for r in state.saved_list(saved).collect()] == ["r", "q"]
    pairs = spark.createDataFrame([(1, "r"), (2, "r")], "user_id int, restaurant_id string")
    assert rows(state.saved_flag(pairs, saved)) == [(1, "r", True), (2, "r", False)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("at"), "id")
    out = state.numbered(df.repartition(13), ["at", "id"], F.lit(100), "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(101, 1101))
    assert [(r["at"], r["id"]) for r in out] == sorted((r["at"], r["id"]) for r in out)


def test_estimate_cache(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    log = spark.createDataFrame(
        [(1, "a", day(1)), (2, "a", day(5)), (3, "a", day(5)), (4, "b", day(1)), (5, "a", day(9))],
        "event_id int, cache_key string, ts timestamp",
    )
    live = state.fresh_estimates(log, F.lit(day(8)), 7)
    # exactly seven days old is expired
    assert [(r["cache_key"], r["event_id"]) for r in live.collect()] == [("a", 3)]


def test_deletes_need_the_owner(spark):
    entries = spark.createDataFrame([(1, 10), (2, 10)], "id int, user_id int")
    deletes = spark.createDataFrame([(1, 10), (2, 11)], "id int, user_id int")
    assert rows(state.apply_deletes(entries, deletes)) == [(2, 10)]
