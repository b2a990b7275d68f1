import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from forage import schemas
from forage.operators import diary, state
from forage.operators.substring import containing
from forage.plans import fetch
from forage.session import folders, work_path
from forage.streaming import folded, ingest, refresh, totals
from forage.streaming.feedback import start_feedback

START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(spark, parts, schema):
    """A stream of one file per part."""
    path = work_path(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- folded log ---------------------------------------------------------------


@pytest.fixture
def log(spark):
    """A log of five batches in which keys are written again and again."""
    path = work_path(spark, "folded")
    rng, want = random.Random(3), {}
    for n in range(5):
        batch = [(rng.randrange(8), k, f"{n}-{k}") for k in range(10)]
        folded.write_batch(spark.createDataFrame(batch, "key int, seq int, value string"), path, n)
        want |= {key: value for key, _, value in batch}
    return path, sorted(want.items())


def read(spark, path):
    return rows(folded.current(spark, path, ["key"], ["seq"]).select("key", "value"))


def test_current_is_the_same_before_and_after_folds(spark, log):
    path, want = log
    assert read(spark, path) == want
    first = folded.fold(spark, path, ["key"], ["seq"])
    assert first.upto == 3 and read(spark, path) == want  # the newest batch may be replayed
    second = folded.fold(spark, path, ["key"], ["seq"], stopped=True)
    assert (second.version, second.upto) == (2, 4) and read(spark, path) == want
    assert folded.fold(spark, path, ["key"], ["seq"], stopped=True) == second
    assert spark.read.parquet(f"{path}/base/{second.base}").count() == len(want)


def test_a_later_batch_wins_over_the_base(spark, log):
    path, want = log
    folded.fold(spark, path, ["key"], ["seq"], stopped=True)
    folded.write_batch(spark.createDataFrame([(want[0][0], 0, "new"), (99, 0, "added")], "key int, seq int, value string"), path, 5)
    assert read(spark, path) == sorted([(want[0][0], "new"), *want[1:], (99, "added")])


def test_a_fold_without_its_manifest_row_is_not_seen(spark, log):
    path, want = log
    head = folded.fold(spark, path, ["key"], ["seq"])
    spark.createDataFrame([(1, 1, "lost", 9)], "key int, seq int, value string, batch_id long").write.parquet(f"{path}/base/version=9-lost")
    assert folded.versions(spark, path)[0] == head and read(spark, path) == want


def test_an_open_reader_keeps_its_version(spark, log):
    path, want = log
    folded.fold(spark, path, ["key"], ["seq"])
    open_reader = folded.current(spark, path, ["key"], ["seq"]).select("key", "value")
    folded.fold(spark, path, ["key"], ["seq"], stopped=True)
    folded.retire(spark, path)
    assert rows(open_reader) == want == read(spark, path)


def test_retired_versions_leave_the_disk(spark, log):
    path, want = log
    for n in range(5, 8):
        folded.fold(spark, path, ["key"], ["seq"])
        folded.write_batch(spark.createDataFrame([(n, 0, f"{n}")], "key int, seq int, value string"), path, n)
    folded.retire(spark, path, keep=1)
    assert len(folders(spark, f"{path}/base")) == 1
    kept = [n for n in folders(spark, f"{path}/log") if n.startswith("batch_id=")]
    assert kept == [f"batch_id={n}" for n in range(6, 8)]
    assert read(spark, path) == sorted({**dict(want), 5: "5", 6: "6", 7: "7"}.items())


def test_an_unfinished_batch_is_not_read(spark, log):
    path, want = log
    spark.createDataFrame([(1, 1, "half")], "key int, seq int, value string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(folded.log_path(path, 5))
    assert folded.finished(spark, path) == list(range(5)) and read(spark, path) == want


def test_no_batch_yet(spark):
    path = work_path(spark, "none")
    assert folded.current(spark, path, ["key"], []) is None and folded.fold(spark, path, ["key"], []) == folded.Head()
    current = spark.createDataFrame([("a",)], "restaurant_id string")
    assert rows(ingest.snapshot(spark, current, path, [])) == [("a",)]


# --- totals -------------------------------------------------------------------

ENTRY = "user_id int, log_date date, calories_kcal double, protein_g double, fat_g double, carb_g double, created_at timestamp"


def entry(user, day, calories, hour=12):
    at = START + dt.timedelta(days=day, hours=hour)
    return (user, at.date(), float(calories), None, 1.0, 2.0, at)


def test_late_entries_count_until_their_day_is_closed(spark):
    parts = [
        [entry(1, 0, 100), entry(2, 0, 10), entry(1, 1, 7)],
        [entry(1, 0, 50, hour=3), entry(1, 2, 1)],  # within two days: counts
        [entry(1, 9, 5)],  # closes the first days, from the batch after the next
        [entry(2, 9, 3)],
        [entry(1, 0, 1000), entry(1, 9, 6)],  # the first row comes too late
    ]
    path = work_path(spark, "totals")
    query = totals.start_totals(files(spark, parts, ENTRY), path, work_path(spark, "state"))
    query.awaitTermination()
    on_time = [r for p in parts for r in p if r[2] != 1000]
    key = lambda df: rows(df.select("user_id", "log_date", "calories", "protein_g", "fat_g", "carb_g"))
    want = key(diary.daily_totals(spark.createDataFrame(on_time, ENTRY)))
    assert key(totals.read_totals(spark, path)) == want
    progress = query.recentProgress
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 2  # only the open days are held
    totals.fold_totals(spark, path)
    totals.fold_totals(spark, path, stopped=True)
    assert key(totals.read_totals(spark, path)) == want


# --- refresh plan ---------------------------------------------------------------


def test_plan_fires_at_its_interval_however_time_passes(spark):
    clock = [[(START + dt.timedelta(minutes=m),)] for m in (5, 70, 20, 600, 601)]
    plan = refresh.pairs(spark, ["beijing", "chengdu"], ["vegan", "halal"])
    runs = refresh.refresh_plan(files(spark, clock, "ts timestamp"), plan, START, delay="1 minute", interval_seconds=3600)
    out = work_path(spark, "runs")
    start_feedback(runs, out, work_path(spark, "state")).awaitTermination()
    found = {}
    for r in spark.read.parquet(out).collect():
        assert r.refresh_key == f"{r.city}|{r.keyword}"
        found.setdefault(r.refresh_key, []).append(r.ts)
    due = [START + dt.timedelta(seconds=30, hours=h) for h in range(10)]
    assert len(found) == 4 and all(sorted(times) == due for times in found.values())


# --- fetching -------------------------------------------------------------------


def test_containing_equals_brute_force(spark):
    rng = random.Random(6)
    names = [("".join(rng.choice("ab#") for _ in range(rng.randrange(9))), rng.choice("xy")) for _ in range(150)] + [("restaurant tofu", "x")] * 3 + [(None, "x")]
    words = [(n, w, rng.choice("xyz")) for n, w in enumerate(["", "a", "ab", "b#a", "ab#ab", "tofu", "aaaa", "restaurant tofu!", "#"] * 2)]
    places = spark.createDataFrame([(k, *n) for k, n in enumerate(names)], "place int, name string, city string")
    needs = spark.createDataFrame(words, "need int, word string, town string")
    got = {(r.need, r.place) for r in containing(needs, "word", places, "name", "place", {"town": "city"}).collect()}
    want = {(n, k) for n, w, t in words for k, (name, c) in enumerate(names) if t == c and name is not None and w in name}
    assert got == want


def dumps(spark):
    near = "116.400,39.900"
    pois = [(str(k % 45), f"Tofu House {k}", "food;vegan", "", "", "", near, ("4", "60"), [], k) for k in range(60)]
    pois += [("900", "", "x", "tofu", "", "", near, ("4", "60"), [], 900), ("", "Tofu lost", "x", "", "", "", near, ("4", "60"), [], 901), ("902", "Tofu far", "x", "", "", "", "117.4,39.9", ("4", "60"), [], 902)]
    osm = [("node", k, 39.9, 116.4, {"amenity": "restaurant", "name": f"Soup {k}"}) for k in range(40)]
    schema = "type string, id long, lat double, lon double, tags map<string, string>"
    return spark.createDataFrame(pois, schemas.MAP_POI + ", arrival int"), spark.createDataFrame(osm, schema)


def test_documents_of_needs(spark):
    searches = [("tofu", 39.9, 116.4), (" TOFU\t", 39.9, 116.4), ("soup", 39.9, 116.4), ("soup", None, 116.4), ("none", 39.9, 116.4), ("soup", 10.0, 10.0)]
    needs = fetch.needs_of(spark.createDataFrame(searches, "q string, lat double, lng double"))
    assert needs.count() == 6
    found = {}
    for r in fetch.documents(needs, *dumps(spark)).join(needs, "need_id").collect():
        found.setdefault((r.q, r.lat), []).append((r.position, r.restaurant_id))
    by_map = [i for _, i in sorted(found[("tofu", 39.9)])]
    assert by_map == [f"amap_{k}" for k in range(30)]
    assert {k for k in found} == {("tofu", 39.9), ("TOFU", 39.9), ("soup", 39.9), ("soup", None)}
    assert all(len(found[("soup", at)]) == 30 and found[("soup", at)][0][1].startswith("osm_node_") for at in (39.9, None))


def test_a_named_place_counts_behind_an_unnamed_one_of_its_id(spark):
    rows = [("7", "", "tofu", 1, "116.400,39.900"), ("7", "Tofu", "tofu", 2, "116.401,39.900"), ("7", "Tofu later", "tofu", 3, "116.402,39.900")]
    pois = spark.createDataFrame([(i, n, "x", t, "", "", at, ("4", "60"), [], k) for i, n, t, k, at in rows], schemas.MAP_POI + ", arrival int")
    needs = fetch.needs_of(spark.createDataFrame([("tofu", 39.9, 116.4)], "q string, lat double, lng double"))
    assert [(r.restaurant_id, r["name"]) for r in fetch.around_map(needs, pois).collect()] == [("amap_7", "Tofu")]


SEARCH = "ts timestamp_ntz, q string, total int, page_offset int, lat double, lng double"


def test_triggered_ingest_over_batches_and_replays(spark):
    """Files out of time order and a second run from the start leave one catalog."""
    at = lambda s: START + dt.timedelta(seconds=s)
    searches = [(at(40 * k), ["tofu", "soup", "served"][k % 3], 9 if k % 3 == 2 else 0, 0, 39.9, 116.4) for k in range(30)]
    closing = [(at(10**6), "later", 0, 0, None, None)]
    stream = lambda: files(spark, [searches[15:], searches[:15], closing], SEARCH)
    pois, osm = dumps(spark)
    path = work_path(spark, "triggered")
    for _ in range(2):
        ingest.start_triggered_ingest(stream(), lambda needs: fetch.documents(needs, pois, osm), path, work_path(spark, "state"), "1 day").awaitTermination()
        current = spark.createDataFrame([("amap_1", "old"), ("kept", "kept")], "restaurant_id string, name string")
        catalog = ingest.snapshot(spark, current, path, ["need_id", "position"])
        names = {r.restaurant_id: r.name for r in catalog.collect()}
        assert len(names) == 61 and names["kept"] == "kept" and names["amap_1"] == "Tofu House 1"
        fired = spark.read.parquet(f"{path}/triggers")
        greedy = lambda first: [first, first + 360, first + 720, first + 1080]
        assert rows(fired.select("q", F.unix_timestamp("ts").alias("t"))) == sorted((q, int((at(s) - dt.datetime(1970, 1, 1)).total_seconds())) for q, first in (("tofu", 0), ("soup", 40)) for s in greedy(first))
        assert rows(ingest.counts(spark, path).select(F.sum("indexed"), F.sum("rejected"))) == [(60, 0)]
    labels = {r.restaurant_id: r.allergens for r in catalog.collect()}
    assert labels["amap_2"] == ["soy"] or "soy" in labels["amap_2"]


# --- counts in the write path -----------------------------------------------------


def test_upsert_counts_are_taken_while_writing(spark):
    current = spark.createDataFrame([("a", "old"), ("b", "keep")], "restaurant_id string, name string")
    batch = spark.createDataFrame([(1, "a", "first"), (2, "a", "last"), (3, None, "lost"), (4, "", "lost")], "seq int, restaurant_id string, name string")
    written, counts = state.upsert_table(current, batch, ["seq"], work_path(spark, "catalog"))
    assert counts == {"indexed": 2, "rejected": 2} == state.upsert_counts(batch).first().asDict()
    assert rows(written) == [("a", "last"), ("b", "keep")]
    _, counts = state.upsert_table(current, batch.filter("seq > 9"), ["seq"], work_path(spark, "catalog"))
    assert counts == {"indexed": 0, "rejected": 0}
    with pytest.raises(Exception, match="restaurant_id"):
        state.upsert_table(current, batch, ["seq"], work_path(spark, "catalog"), strict=True)
