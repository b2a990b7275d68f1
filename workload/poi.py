"""Points of interest from the bound supplier views."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import fixed
from forage.functions import poi as rules
from forage.operators.guard import primary_or_fallback
from forage.operators.trigger import ingest_cap as cap_documents
from forage.plans.ingest import ingest
from forage.sources import poi
from workload import sql
from workload.bindings import ctes, restaurants, view
from workload.registry import query


def pois(spark, sf_dir, **streams):
    """Map-service POIs in their raw nested layout."""
    rows = view(spark, sf_dir, "poi_map", **streams)
    photo = F.struct(F.col("photo").alias("url"))
    return rows.select(
        F.col("id").cast("string").alias("id"), "name", "type", "tag", F.lit("").alias("address"), F.lit("").alias("tel"), "location",
        F.struct("rating", "cost").alias("biz_ext"),
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(F.when(F.col("photo") == "", "").otherwise(F.concat("photo", i.cast("string"))).alias("url"))).alias("photos"),
        "arrival",
    )


def features(spark, sf_dir):
    """Map features with their tag map; nodes have a place of their own, ways only a centre."""
    rows = view(spark, sf_dir, "poi_osm")
    tags = {
        "amenity": "tag_amenity", "name": "tag_name", "name:zh": "tag_name_zh", "cuisine": "tag_cuisine",
        "diet:vegetarian": "tag_diet_vegetarian", "diet:gluten_free": "tag_diet_gluten_free",
        "price_level": "tag_price_level", "addr:street": "tag_street",
    }
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in tags.items()]),
        lambda e: e["value"].isNotNull(),
    )
    return rows.select(
        "type", "id", *[F.when(F.col("type") != "way", F.col(c)).alias(c) for c in ("lat", "lon")],
        F.when(F.col("type") == "way", F.struct((F.col("lat") + 0.001).alias("lat"), "lon")).alias("center"),
        F.map_from_entries(entries).alias("tags"),
    )


OSM = ctes("poi_osm")
# ways are placed by their centre, a little north of the bound place
_OSM_LAT = "CASE WHEN type = 'way' THEN lat + 0.001e0 ELSE lat END"
MAP = ctes("poi_map")

_CUISINE = (
    "CASE trim(split_part(coalesce(tag_cuisine, ''), ';', 1)) "
    + " ".join(f"WHEN {sql.quote(k)} THEN {sql.quote(v)}" for k, v in fixed.CUISINE_NAMES.items())
    + " ELSE coalesce(nullif(tag_cuisine, ''), '餐厅') END"
)
_DIET = """list_filter([CASE WHEN contains(coalesce(tag_cuisine, ''), 'vegan') THEN 'vegan' END,
  CASE WHEN contains(coalesce(tag_cuisine, ''), 'vegan') OR contains(coalesce(tag_cuisine, ''), 'vegetarian') OR tag_diet_vegetarian IN ('yes', 'only') THEN 'vegetarian' END,
  CASE WHEN contains(coalesce(tag_cuisine, ''), 'halal') THEN 'halal' END,
  CASE WHEN tag_diet_gluten_free IN ('yes', 'only') THEN 'gluten-free' END], lambda v: v IS NOT NULL)"""


@query(
    "osm_normalize",
    OSM + f"""SELECT concat('osm_', type, '_', CAST(id AS VARCHAR)) AS restaurant_id, coalesce(tag_name, tag_name_zh) AS name, {_CUISINE} AS cuisine_type,
    coalesce(tag_street, '') AS address, CASE WHEN tag_price_level = '2' THEN 2 END AS price_level,
    {_OSM_LAT} AS lat, lon AS lng, array_to_string(list_sort({_DIET}), ',') AS diet_labels, 'osm' AS source
    FROM poi_osm WHERE coalesce(tag_name, tag_name_zh) IS NOT NULL""",
)
def osm_normalize(spark, sf_dir):
    return poi.normalize_features(features(spark, sf_dir)).select(
        "restaurant_id", "name", "cuisine_type", "address", "price_level", "geo.lat", "geo.lng",
        F.array_join(F.array_sort("diet_labels"), ",").alias("diet_labels"), "source",
    )


@query("osm_cuisine", OSM + f"SELECT id, {_CUISINE} AS cuisine FROM poi_osm")
def osm_cuisine(spark, sf_dir):
    return features(spark, sf_dir).select("id", rules.cuisine_name(F.col("tags")["cuisine"]).alias("cuisine"))


@query("osm_diet_tags", OSM + f"SELECT id, array_to_string(list_sort({_DIET}), ',') AS labels FROM poi_osm")
def osm_diet_tags(spark, sf_dir):
    found = rules.diet_labels(F.col("tags")["cuisine"], F.col("tags"))
    return features(spark, sf_dir).select("id", F.array_join(F.array_sort(found), ",").alias("labels"))


_BUCKET = "CASE WHEN TRY_CAST(cost AS DOUBLE) IS NULL THEN NULL WHEN TRY_CAST(cost AS DOUBLE) < 50 THEN 1 WHEN TRY_CAST(cost AS DOUBLE) < 100 THEN 2 WHEN TRY_CAST(cost AS DOUBLE) < 200 THEN 3 ELSE 4 END"
_LAT = "coalesce(TRY_CAST(split_part(location, ',', 2) AS DOUBLE), 0e0)"
_LNG = "CASE WHEN TRY_CAST(split_part(location, ',', 2) AS DOUBLE) IS NULL THEN 0e0 ELSE coalesce(TRY_CAST(split_part(location, ',', 1) AS DOUBLE), 0e0) END"


def _normal_sql(prefix, source, keep, default, where=""):
    photos = " || ',' || ".join(f"photo || '{i}'" for i in range(1, keep + 1))
    return (
        f"SELECT arrival, '{prefix}' || CAST(id AS VARCHAR) AS restaurant_id, name, tag AS description, CASE WHEN type = '' THEN '{default}' ELSE split_part(type, ';', -1) END AS cuisine_type, "
        f"{_BUCKET} AS price_level, TRY_CAST(rating AS DOUBLE) AS rating, {_LAT} AS lat, {_LNG} AS lng, "
        f"CASE WHEN photo = '' THEN '' ELSE {photos} END AS images, '{source}' AS source FROM poi_map{where}"
    )


@query(
    "poi_normalize",
    MAP + "SELECT * EXCLUDE (arrival) FROM ("
    + _normal_sql("gaode_", "gaode", 5, "") + " UNION ALL " + _normal_sql("amap_", "amap_web", 4, "餐厅", " WHERE name <> ''") + ")",
)
def poi_normalize(spark, sf_dir):
    raw = pois(spark, sf_dir)
    both = poi.normalize_pois(raw, "official").unionByName(poi.normalize_pois(raw, "web"))
    return both.select(
        "restaurant_id", "name", "description", "cuisine_type", "price_level", "rating", "geo.lat", "geo.lng",
        F.array_join("images", ",").alias("images"), "source",
    )


@query("price_bucket", MAP + f"SELECT arrival, {_BUCKET} AS price_level FROM poi_map")
def price_bucket(spark, sf_dir):
    return view(spark, sf_dir, "poi_map").select("arrival", rules.price_bucket(F.col("cost")).alias("price_level"))


@query("poi_location", MAP + f"SELECT arrival, {_LAT} AS lat, {_LNG} AS lng FROM poi_map")
def poi_location(spark, sf_dir):
    return view(spark, sf_dir, "poi_map").select("arrival", F.inline(F.array(rules.location(F.col("location")))))


_KIND4 = "(tag_amenity = 'restaurant' OR (tag_amenity IN ('cafe', 'fast_food') AND type = 'node'))"
_KIND3 = "(tag_amenity = 'restaurant' OR (tag_amenity = 'cafe' AND type = 'node'))"


@query(
    "poi_around",
    OSM + f"SELECT type, id FROM poi_osm WHERE {_KIND4} AND {sql.haversine('39.95e0', '116.4e0', _OSM_LAT, 'lon')} <= 20e0 AND regexp_matches(tag_name, 'supplier#0+[0-9]*[1-7]$', 'i')",
)
def poi_around(spark, sf_dir):
    return poi.features_around(features(spark, sf_dir), 39.95, 116.4, 20_000, "supplier#0+[0-9]*[1-7]$").select("type", "id")


@query("poi_bbox", OSM + f"SELECT type, id FROM poi_osm WHERE {_KIND3} AND {_OSM_LAT} BETWEEN 39.8e0 AND 40.1e0 AND lon BETWEEN 116.2e0 AND 116.6e0")
def poi_bbox(spark, sf_dir):
    return poi.features_in_box(features(spark, sf_dir), (39.8, 116.2, 40.1, 116.6)).select("type", "id")


_BOXES = ", ".join(f"('{c}', {s}e0, {w}e0, {n}e0, {e}e0)" for c, (s, w, n, e) in fixed.CITY_BOXES.items())


@query(
    "poi_city",
    OSM + f""", boxes AS (SELECT * FROM (VALUES {_BOXES}) b(resolved, s, w, n, e)),
    asked AS (SELECT DISTINCT c_mktsegment AS city, 'beijing' AS resolved FROM customer UNION SELECT 'Shanghai', 'shanghai' UNION SELECT 'BEIJING', 'beijing')
    SELECT city, resolved, type, id FROM poi_osm, asked JOIN boxes USING (resolved)
    WHERE {_KIND3} AND {_OSM_LAT} BETWEEN s AND n AND lon BETWEEN w AND e""",
)
def poi_city(spark, sf_dir):
    from workload.bindings import table

    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("city")).distinct()
    known = spark.createDataFrame([("Shanghai",), ("BEIJING",)], "city string")
    return poi.in_cities(features(spark, sf_dir), segments.unionByName(known)).select("city", "resolved", "type", "id")


@query(
    "poi_keyword_page",
    MAP + "SELECT arrival, name FROM poi_map WHERE (contains(lower(name), 'tofu') OR contains(lower(tag), 'tofu') OR contains(lower(type), 'tofu')) "
    "AND starts_with(type, 'catering') ORDER BY arrival LIMIT 25 OFFSET 25",
)
def poi_keyword_page(spark, sf_dir):
    return poi.keyword_page(pois(spark, sf_dir), "Tofu", page=2, category="catering").select("arrival", "name")


@query(
    "poi_around_page",
    MAP + f""", p AS (SELECT arrival, {sql.haversine('39.85e0', '116.4e0', _LAT, _LNG)} AS km FROM poi_map WHERE contains(lower(tag), 'tofu'))
    SELECT arrival, round(km, 6) AS km FROM p WHERE km <= 40e0 ORDER BY km, arrival LIMIT 20 OFFSET 20""",
)
def poi_around_page(spark, sf_dir):
    # the SQL orders by its rounded output
    page = poi.around_page(pois(spark, sf_dir), 39.85, 116.4, 40_000, page=2, page_size=20, keyword="tofu", digits=6)
    return page.select("arrival", "km")


@query(
    "poi_requests_page",
    MAP + f""", asked AS (SELECT c_custkey AS request_id, 39.75e0 + (c_custkey % 20) / 100e0 AS lat, 116.10e0 + (c_custkey % 60) / 100e0 AS lng,
      c_custkey % 3 + 1 AS page, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'tofu' ELSE 'peanut' END AS keyword FROM customer),
    placed AS (SELECT arrival, lower(concat(name, '|', tag, '|', type)) AS body, {_LAT} AS plat, {_LNG} AS plng FROM poi_map),
    met AS (SELECT request_id, page, arrival, {sql.haversine('lat', 'lng', 'plat', 'plng')} AS km FROM asked, placed WHERE contains(body, coalesce(keyword, ''))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY km, arrival) AS position FROM met WHERE km <= 12e0)
    SELECT request_id, CAST(position AS INT) AS position, arrival, round(km, 6) AS km FROM ranked WHERE position > (page - 1) * 5 AND position <= page * 5""",
)
def poi_requests_page(spark, sf_dir):
    """Requests from a table, so both sides of the join grow."""
    from workload.bindings import table

    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(
        key.alias("request_id"), (39.75 + (key % 20) / 100).alias("lat"), (116.10 + (key % 60) / 100).alias("lng"), F.lit(12.0).alias("radius_km"),
        (key % 3 + 1).alias("page"), F.lit(5).alias("page_size"), F.when(key % 4 == 1, "").when(key % 4 == 2, "Tofu").when(key % 4 == 3, "peanut").alias("keyword"),
    )
    return poi.pages_around(pois(spark, sf_dir), asked).select("request_id", "position", "arrival", F.round("km", 6).alias("km"))


@query("poi_dedup", MAP + "SELECT CAST(id AS VARCHAR) AS id, min(arrival) AS arrival, arg_min(name, arrival) AS name FROM poi_map GROUP BY 1")
def poi_dedup(spark, sf_dir):
    return poi.first_seen(pois(spark, sf_dir), "id", ["arrival"]).select("id", "arrival", "name")


# areas are tenths of a degree, taken from the places themselves
_AREA = "concat(CAST(floor({lat} * 10) AS BIGINT), ',', CAST(floor({lng} * 10) AS BIGINT))"


@query(
    "source_fallback",
    MAP + OSM.replace("WITH ", ", ", 1) + f""", p AS (SELECT *, {_AREA.format(lat='lat', lng='lng')} AS area FROM ({_normal_sql('gaode_', 'gaode', 5, '')}))
    , f AS (SELECT {_AREA.format(lat=_OSM_LAT, lng='lon')} AS area, concat('osm_', type, '_', CAST(id AS VARCHAR)) AS restaurant_id, coalesce(tag_name, tag_name_zh) AS name, {_CUISINE} AS cuisine_type,
      CASE WHEN tag_price_level = '2' THEN 2 END AS price_level, CAST(NULL AS DOUBLE) AS rating, {_OSM_LAT} AS lat, lon AS lng, 'osm' AS source FROM poi_osm WHERE coalesce(tag_name, tag_name_zh) IS NOT NULL)
    SELECT area, restaurant_id, name, cuisine_type, price_level, rating, lat, lng, source FROM p
    UNION ALL SELECT * FROM f WHERE area NOT IN (SELECT area FROM p)""",
)
def source_fallback(spark, sf_dir):
    """Whole documents of the first source, and of the second in areas where the first has none."""
    part = lambda name: F.floor(F.col(f"geo.{name}") * 10).cast("bigint").cast("string")
    placed = lambda rows: rows.withColumn("area", F.concat(part("lat"), F.lit(","), part("lng")))
    found = primary_or_fallback(placed(poi.normalize_pois(pois(spark, sf_dir))), placed(poi.normalize_features(features(spark, sf_dir))), "area")
    return found.select("area", "restaurant_id", "name", "cuisine_type", "price_level", "rating", "geo.lat", "geo.lng", "source")


@query(
    "ingest_cap",
    ctes("poi_map") + "SELECT key, arrival FROM (SELECT split_part(type, ';', -1) AS key, arrival, row_number() OVER (PARTITION BY split_part(type, ';', -1) ORDER BY arrival) AS rn FROM poi_map) WHERE rn <= 30",
)
def ingest_cap(spark, sf_dir):
    found = view(spark, sf_dir, "poi_map").select(rules.last_category(F.col("type"), "").alias("key"), "arrival")
    return cap_documents(found, "key", [F.asc("arrival")], "arrival").select("key", "arrival")


def ingest_sql():
    text = "concat_ws(' ', nullif(name, ''), description, cuisine_type)"
    merged = lambda rules_: f"list_sort(list_distinct({sql.rule_list('body', rules_)}))"
    return f""", norm AS ({_normal_sql('gaode_', 'gaode', 5, '')}),
    b AS (SELECT *, {text} AS body FROM norm),
    lab AS (SELECT *, {merged(fixed.DIET_RULES)} AS d, {merged(fixed.ALLERGEN_RULES)} AS a, {merged(fixed.ALLERGEN_FREE_RULES)} AS f FROM b),
    fresh AS (SELECT restaurant_id, arg_max_null(name, arrival) AS name, arg_max_null(price_level, arrival) AS price_level, arg_max_null(d, arrival) AS d, arg_max_null(a, arrival) AS a, arg_max_null(f, arrival) AS f FROM lab GROUP BY restaurant_id)"""


INGEST_ROWS = """SELECT restaurant_id, name, price_level, array_to_string(d, ',') AS diet_labels, array_to_string(a, ',') AS allergens,
    array_to_string(list_filter(f, lambda v: NOT list_contains(a, v)), ',') AS allergen_free FROM fresh"""


@query(
    "ingest_pipeline",
    ctes("restaurants", "poi_map") + ingest_sql() + " " + INGEST_ROWS
    + " UNION ALL SELECT restaurant_id, name, price_level, coalesce(diet_labels, ''), coalesce(allergens, ''), coalesce(allergen_free, '') FROM restaurants",
)
def ingest_pipeline(spark, sf_dir):
    raw = pois(spark, sf_dir)
    fetched = poi.normalize_pois(raw, keep=("arrival",))
    return ingest_columns(ingest(restaurants(spark, sf_dir), fetched, ["arrival"]))


def ingest_columns(catalog):
    return catalog.select(
        "restaurant_id", "name", "price_level", *[F.array_join(c, ",").alias(c) for c in ("diet_labels", "allergens", "allergen_free")]
    )
