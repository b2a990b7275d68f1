"""Streaming jobs run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import fixed
from forage.operators.trigger import requests_to_check
from forage.plans import fetch
from forage.session import work_path
from forage.sources import poi
from forage.streaming import feedback as feedback_stream
from forage.streaming import folded
from forage.streaming import ingest as ingest_stream
from forage.streaming import refresh as refresh_stream
from forage.streaming import totals as totals_stream
from forage.streaming.trigger import stream_triggers
from workload import diary as diary_queries
from workload import sql
from workload.bindings import ctes, restaurants, table, view
from workload.poi import _CUISINE, _DIET, _KIND3, _KIND4, _OSM_LAT, INGEST_ROWS, _normal_sql, features, ingest_columns, ingest_sql, pois
from workload.registry import query
from workload.state import _KEY, _SHORT, _greedy


def arriving(spark, sf_dir, name):
    """A driver table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def in_files(spark, rows, parts):
    """The rows as a stream of one file per part, in the order of the parts."""
    path = work_path(spark, "arriving")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "stream_ingest",
    ctes("restaurants", "poi_map") + ingest_sql() + " " + INGEST_ROWS
    + " UNION ALL SELECT restaurant_id, name, price_level, coalesce(diet_labels, ''), coalesce(allergens, ''), coalesce(allergen_free, '') FROM restaurants",
)
def stream_ingest(spark, sf_dir):
    """Three files in arrival order, with the log folded between and after them."""
    rows = table(spark, sf_dir, "supplier")
    low, high = rows.approxQuantile("s_suppkey", [1 / 3, 2 / 3], 0.01)
    key = F.col("s_suppkey")
    files = [rows.filter(part) for part in (key <= low, (key > low) & (key <= high), key > high)]
    raw = pois(spark, sf_dir, supplier=in_files(spark, rows, files))
    log = work_path(spark, "ingest-log")
    ingest_stream.start_ingest(poi.normalize_pois(raw, keep=("arrival",)), log, work_path(spark, "ingest-state")).awaitTermination()
    folded.fold(spark, log, ingest_stream.KEY, ["arrival"])
    folded.fold(spark, log, ingest_stream.KEY, ["arrival"], stopped=True)
    folded.retire(spark, log)
    return ingest_columns(ingest_stream.snapshot(spark, restaurants(spark, sf_dir), log, ["arrival"]))


@query(
    "stream_daily_totals",
    ctes("food_log") + f"SELECT user_id, log_date, {diary_queries._SUMS} FROM food_log GROUP BY ALL",
)
def stream_daily_totals(spark, sf_dir):
    """Sums held in the state store, each changed day written per batch, and the log folded."""
    log = view(spark, sf_dir, "food_log", lineitem=arriving(spark, sf_dir, "lineitem"))
    path = work_path(spark, "totals")
    totals_stream.start_totals(log, path, work_path(spark, "totals-state")).awaitTermination()
    totals_stream.fold_totals(spark, path, stopped=True)
    return diary_queries._rounded(totals_stream.read_totals(spark, path), "user_id", "log_date")


@query("stream_feedback", ctes("feedback") + "SELECT id, user_id, query_id, restaurant_id, rank_position, is_relevant FROM feedback")
def stream_feedback(spark, sf_dir):
    rows = view(spark, sf_dir, "feedback", events=arriving(spark, sf_dir, "events"))
    path = work_path(spark, "feedback")
    feedback_stream.start_feedback(rows, path, work_path(spark, "feedback-state")).awaitTermination()
    return spark.read.parquet(path).select("id", "user_id", "query_id", "restaurant_id", "rank_position", "is_relevant")


@query("stream_trigger", _greedy(ctes("search_log").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SHORT, "trigger_key", 300))
def stream_trigger(spark, sf_dir):
    """Stateful stream; equal to ``trigger_ttl``.

    The log arrives as several files out of time order, then one event of a year later that closes it.
    """
    log = shuffled_log(spark, sf_dir, "search_log")
    path = work_path(spark, "triggers")
    fired = stream_triggers(log, "365 days").select("trigger_key", F.col("ts").cast("timestamp_ntz").alias("ts"))
    feedback_stream.start_feedback(fired, path, work_path(spark, "triggers-state")).awaitTermination()
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"))
    return spark.read.parquet(path).join(last.withColumnRenamed("ts", "last"), F.col("ts") <= F.col("last")).drop("last")


def shuffled_log(spark, sf_dir, name):
    """A search log view over events that come as three files out of time order, and one search a year later that closes them."""
    rows = table(spark, sf_dir, "events")
    short = requests_to_check(view(spark, sf_dir, name)).agg(F.max("event_id").alias("event_id"))
    later = rows.join(short, "event_id").select(rows.columns).withColumn("ts", F.col("ts") + F.expr("INTERVAL 366 DAYS"))
    files = [rows.filter(F.pmod("event_id", F.lit(3)) == k) for k in (2, 0, 1)]
    return view(spark, sf_dir, name, events=in_files(spark, rows, [*files, later]))


def _fetched_sql(needs, cap):
    """Documents of ``needs`` (need_id, q, lat, lng) and their labels: the map service around a place, else the features around it, else those of the default city."""
    south, west, north, east = fixed.CITY_BOXES[fixed.DEFAULT_CITY]
    km = lambda lat, lng: sql.haversine("n.lat", "n.lng", lat, lng)
    holds = lambda *cs: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), lower(n.q))" for c in cs) + ")"
    return f""", needs AS ({needs}),
    web AS (SELECT * FROM ({_normal_sql('amap_', 'amap_web', 4, '餐厅')}) JOIN (SELECT arrival, id, type FROM poi_map) USING (arrival)),
    paged AS (SELECT need_id, w.*, row_number() OVER (PARTITION BY need_id ORDER BY {km('w.lat', 'w.lng')}, arrival) AS p
      FROM needs n JOIN web w ON n.lat IS NOT NULL AND {km('w.lat', 'w.lng')} <= 5e0 AND {holds('w.name', 'w.description', 'w.type')}),
    around_map AS (SELECT need_id, p, restaurant_id, name, description, cuisine_type, price_level, [] AS own FROM paged WHERE p <= 40 AND name <> '' QUALIFY row_number() OVER (PARTITION BY need_id, id ORDER BY p) = 1),
    osm AS (SELECT *, concat('osm_', type, '_', CAST(id AS VARCHAR)) AS restaurant_id, coalesce(tag_name, tag_name_zh) AS name, '' AS description, {_CUISINE} AS cuisine_type,
      CASE WHEN tag_price_level = '2' THEN 2 END AS price_level, {_OSM_LAT} AS plat, lon AS plng, {_DIET} AS own FROM poi_osm),
    around_osm AS (SELECT need_id, row_number() OVER (PARTITION BY need_id ORDER BY {km('plat', 'plng')}, restaurant_id) AS p, restaurant_id, name, description, cuisine_type, price_level, own
      FROM needs n JOIN osm ON n.lat IS NOT NULL AND {_KIND4} AND {km('plat', 'plng')} <= 5e0 AND {holds('tag_name')} WHERE need_id NOT IN (SELECT need_id FROM around_map)),
    city_osm AS (SELECT need_id, row_number() OVER (PARTITION BY need_id ORDER BY restaurant_id) AS p, restaurant_id, name, description, cuisine_type, price_level, own
      FROM needs n JOIN osm ON n.lat IS NULL AND {_KIND3} AND plat BETWEEN {south}e0 AND {north}e0 AND plng BETWEEN {west}e0 AND {east}e0 AND {holds('tag_name')}),
    found AS (SELECT * FROM (SELECT * FROM around_map UNION ALL SELECT * FROM around_osm UNION ALL SELECT * FROM city_osm)
      {f"QUALIFY row_number() OVER (PARTITION BY need_id ORDER BY p, restaurant_id) <= {cap}" if cap else ""}),
    won AS (SELECT *, concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(cuisine_type, '')) AS body FROM found QUALIFY row_number() OVER (PARTITION BY restaurant_id ORDER BY need_id DESC) = 1),
    lab AS (SELECT *, list_sort(list_distinct(list_concat(own, {sql.rule_list('body', fixed.DIET_RULES)}))) AS d, list_sort(list_distinct({sql.rule_list('body', fixed.ALLERGEN_RULES)})) AS a,
      list_sort(list_distinct({sql.rule_list('body', fixed.ALLERGEN_FREE_RULES)})) AS f FROM won)
    SELECT restaurant_id, name, price_level, array_to_string(d, ',') AS diet_labels, array_to_string(a, ',') AS allergens, array_to_string(list_filter(f, lambda v: NOT list_contains(a, v)), ',') AS allergen_free FROM lab
    UNION ALL SELECT restaurant_id, name, price_level, coalesce(diet_labels, ''), coalesce(allergens, ''), coalesce(allergen_free, '') FROM restaurants"""


_FIRES = """, ev AS (SELECT {key} AS trigger_key, q, lat, lng, ts FROM cravings WHERE total < 5 AND page_offset = 0 AND q <> ''),
    fires AS (SELECT trigger_key AS k, min(ts) AS at FROM ev GROUP BY 1
      UNION ALL SELECT f.k, (SELECT min(e.ts) FROM ev e WHERE e.trigger_key = f.k AND e.ts >= f.at + INTERVAL 300 SECOND) AS at FROM fires f WHERE f.at IS NOT NULL)"""
_PLACE = "CASE WHEN lat IS NULL OR lng IS NULL THEN 'nogeo' ELSE CAST(lat AS VARCHAR) || ',' || CAST(lng AS VARCHAR) END"


@query(
    "triggered_ingest",
    ctes("restaurants", "poi_map", "poi_osm", "cravings").replace("WITH ", "WITH RECURSIVE ", 1) + _FIRES.format(key=_KEY)
    + _fetched_sql(
        f"SELECT DISTINCT sha256({_PLACE} || '@' || {sql.squish('q')}) AS need_id, {sql.squish('q')} AS q, lat, lng FROM ev JOIN fires ON k = trigger_key AND fires.at = ts",
        fixed.TRIGGER_INGEST_CAP,
    ),
)
def triggered_ingest(spark, sf_dir):
    """Searches that fire fetch their places, up to the cap, which are labelled and merged into the catalog, all in one stream."""
    log = shuffled_log(spark, sf_dir, "cravings")
    dumps = pois(spark, sf_dir), features(spark, sf_dir)
    path = work_path(spark, "triggered")
    ingest_stream.start_triggered_ingest(log, lambda needs: fetch.documents(needs, *dumps), path, work_path(spark, "triggered-state"), "365 days").awaitTermination()
    folded.fold(spark, path, ingest_stream.KEY, ["need_id", "position"], stopped=True)
    return ingest_columns(ingest_stream.snapshot(spark, restaurants(spark, sf_dir), path, ["need_id", "position"]))


def _runs_sql(cities, words, seconds):
    return (
        f"SELECT city || '|' || keyword AS refresh_key, city, keyword, unnest(generate_series((SELECT min(ts) FROM events) + INTERVAL 30 SECOND, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE, INTERVAL {seconds} SECOND)) AS ts "
        f"FROM (SELECT unnest({sql.strings(cities)}) AS city), (SELECT unnest({sql.strings(words)}) AS keyword)"
    )


def _clock(spark, sf_dir):
    return arriving(spark, sf_dir, "events"), table(spark, sf_dir, "events").agg(F.min("ts").alias("ts")).first()["ts"]


@query("refresh_plan", f"SELECT refresh_key, city, keyword, date_trunc('milliseconds', ts) AS ts FROM ({_runs_sql(fixed.REFRESH_CITIES, fixed.REFRESH_KEYWORDS, fixed.REFRESH_INTERVAL_SECONDS)})")
def refresh_plan(spark, sf_dir):
    """Every pair of city and keyword each hour, driven by the event times of the table."""
    clock, start = _clock(spark, sf_dir)
    path = work_path(spark, "runs")
    runs = refresh_stream.refresh_plan(clock, refresh_stream.pairs(spark), start).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    feedback_stream.start_feedback(runs, path, work_path(spark, "runs-state")).awaitTermination()
    return spark.read.parquet(path)


_REFRESHED = ["Supplier#00", "7", "zh ", "#000000001", "none"]


@query(
    "refresh_ingest",
    ctes("restaurants", "poi_map", "poi_osm")
    + _fetched_sql(f"SELECT DISTINCT refresh_key AS need_id, keyword AS q, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng FROM ({_runs_sql(fixed.REFRESH_CITIES[:1], _REFRESHED, 86400)})", None),
)
def refresh_ingest(spark, sf_dir):
    """Daily runs of name keywords over all cities, fed to the catalog; only the first city has places here."""
    clock, start = _clock(spark, sf_dir)
    plan = refresh_stream.refresh_plan(clock, refresh_stream.pairs(spark, keywords=_REFRESHED), start, interval_seconds=86400)
    dump, path = features(spark, sf_dir), work_path(spark, "refreshed")
    ingest_stream.start_refresh_ingest(plan, lambda needs: fetch.city_features(needs, dump), path, work_path(spark, "refreshed-state")).awaitTermination()
    return ingest_columns(ingest_stream.snapshot(spark, restaurants(spark, sf_dir), path, ["need_id", "position"]))
