"""Catalog reads, lookups, merges and name completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage import schemas
from forage.operators import filters, state
from forage.session import work_path
from forage.sources import food as food_source
from forage.sources.catalog import union_sources
from workload.bindings import ctes, restaurants, table, view, words
from workload.registry import query


def with_menu(spark, sf_dir):
    """The bound catalog with nested menu items."""
    item = F.struct(
        "item_id", "name", F.lit(None).cast("string").alias("description"), "price", "calories",
        *[F.lit(None).cast("double").alias(c) for c in ("protein_g", "fat_g", "carb_g")],
        words("item_labels").alias("diet_labels"), F.array().cast("array<string>").alias("allergens"),
    )
    # a menu belongs to one restaurant and is part of its document
    menus = view(spark, sf_dir, "menu_items").groupBy("restaurant_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("name", "item_id", item.alias("item")))), lambda m: m["item"]
        ).alias("menu_items")
    )
    return restaurants(spark, sf_dir).join(menus, "restaurant_id", "left")


@query(
    "catalog_scan",
    ctes("restaurants") + "SELECT restaurant_id, name, length(description) AS n, price_level, rating, lat, lng, diet_labels FROM restaurants",
)
def catalog_scan(spark, sf_dir):
    """The bound catalog as it is read by every other query."""
    return restaurants(spark, sf_dir).select(
        "restaurant_id", "name", F.char_length("description").cast("bigint").alias("n"), "price_level", "rating",
        "geo.lat", "geo.lng", F.nullif(F.array_join("diet_labels", ","), F.lit("")).alias("diet_labels"),
    )


@query(
    "lookup_by_id",
    ctes("restaurants", "feedback", "food_items", "food_log")
    + "SELECT restaurant_id AS id, name FROM restaurants WHERE restaurant_id IN (SELECT restaurant_id FROM feedback) "
    "UNION ALL SELECT CAST(food_id AS VARCHAR), name_en FROM food_items WHERE food_id IN (SELECT food_id FROM food_log)",
)
def lookup_by_id(spark, sf_dir):
    """Restaurants that got feedback, and foods that were eaten."""
    places = filters.lookup(restaurants(spark, sf_dir), view(spark, sf_dir, "feedback"), "restaurant_id")
    foods = filters.lookup(view(spark, sf_dir, "food_items"), view(spark, sf_dir, "food_log"), "food_id")
    return places.select(F.col("restaurant_id").alias("id"), "name").unionByName(
        foods.select(F.col("food_id").cast("string").alias("id"), F.col("name_en").alias("name"))
    )


@query(
    "menu_items",
    ctes("restaurants", "menu_items") + "SELECT r.restaurant_id, m.item_id, m.name, m.price, m.calories, m.item_labels AS diet_labels "
    "FROM restaurants r LEFT JOIN menu_items m USING (restaurant_id)",
)
def menu_items(spark, sf_dir):
    return filters.menu_listing(with_menu(spark, sf_dir)).select(
        "restaurant_id", "item_id", "name", "price", "calories",
        F.nullif(F.array_join("diet_labels", ","), F.lit("")).alias("diet_labels"),
    )


@query(
    "autocomplete",
    ctes("restaurants") + """, p AS (SELECT DISTINCT 'kitchen ' || source AS prefix FROM documents UNION SELECT 'K' UNION SELECT 'Kitch' UNION SELECT 'x'),
    m AS (SELECT prefix, name, row_number() OVER (PARTITION BY prefix ORDER BY name) AS position FROM (SELECT DISTINCT name FROM restaurants), p
    WHERE starts_with(lower(name), lower(prefix))) SELECT prefix, name, CAST(position AS INT) AS position FROM m WHERE position <= 8""",
)
def autocomplete(spark, sf_dir):
    typed = table(spark, sf_dir, "documents").select(F.concat(F.lit("kitchen "), "source").alias("prefix"))
    short = spark.createDataFrame([("K",), ("Kitch",), ("x",)], "prefix string")
    return filters.autocomplete(typed.unionByName(short), restaurants(spark, sf_dir))


BATCH = """, batch AS (SELECT s_suppkey AS arrival, CASE WHEN s_suppkey % 10 = 3 THEN NULL WHEN s_suppkey % 10 = 4 THEN ''
      ELSE concat('doc_', CAST(s_suppkey % 60 AS VARCHAR)) END AS restaurant_id,
      CASE WHEN s_suppkey % 20 = 3 THEN concat('new_', CAST(s_suppkey AS VARCHAR)) END AS _id, s_name AS name, 'fresh ' || s_name AS description, 2 AS price_level, CAST(s_suppkey % 5 AS DOUBLE) AS rating,
      CASE WHEN s_suppkey % 2 = 0 THEN 'vegan,halal' END AS diet_labels FROM supplier),
    keyed AS (SELECT *, coalesce(nullif(restaurant_id, ''), _id) AS k FROM batch)"""


def _batch(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("arrival"),
        F.when(key % 10 == 3, F.lit(None)).when(key % 10 == 4, "").otherwise(F.concat(F.lit("doc_"), (key % 60).cast("string"))).alias("restaurant_id"),
        F.when(key % 20 == 3, F.concat(F.lit("new_"), key.cast("string"))).alias("_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("fresh "), "s_name").alias("description"),
        F.lit(2).alias("price_level"),
        (key % 5).cast("double").alias("rating"),
        F.when(key % 2 == 0, F.array(F.lit("vegan"), F.lit("halal"))).alias("diet_labels"),
    )


# a batch document replaces the whole old one: what it does not say is gone
MERGED = BATCH + """, fresh AS (SELECT k AS restaurant_id, max_by(name, arrival) AS name, max_by(description, arrival) AS description, CAST(NULL AS VARCHAR) AS cuisine_type,
      CAST(NULL AS VARCHAR) AS address, max_by(price_level, arrival) AS price_level, max_by(rating, arrival) AS rating, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng,
      CASE WHEN max(arrival) % 2 = 0 THEN 'vegan,halal' END AS diet_labels, CAST(NULL AS VARCHAR) AS allergens, CAST(NULL AS VARCHAR) AS allergen_free FROM keyed WHERE k IS NOT NULL GROUP BY k),
    merged AS (SELECT restaurant_id, name, description, cuisine_type, address, price_level, rating, lat, lng, diet_labels, allergens, allergen_free
      FROM restaurants WHERE restaurant_id NOT IN (SELECT restaurant_id FROM fresh)
    UNION ALL SELECT * FROM fresh)"""


def _merge(spark, sf_dir):
    return state.upsert(restaurants(spark, sf_dir), _batch(spark, sf_dir), ["arrival"])


def _flat(catalog):
    """Whole documents with places and lists as plain columns."""
    lists = [F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("diet_labels", "allergens", "allergen_free")]
    return catalog.select("restaurant_id", "name", "description", "cuisine_type", "address", "price_level", "rating", "geo.lat", "geo.lng", *lists)


@query("catalog_upsert", ctes("restaurants") + MERGED + " SELECT * FROM merged")
def catalog_upsert(spark, sf_dir):
    return _flat(_merge(spark, sf_dir))


@query("upsert_counts", "WITH x AS (SELECT 1)" + BATCH + " SELECT count(*) FILTER (k IS NOT NULL) AS indexed, count(*) FILTER (k IS NULL) AS rejected FROM keyed")
def upsert_counts(spark, sf_dir):
    return state.upsert_counts(_batch(spark, sf_dir))


@query(
    "upsert_observed",
    ctes("restaurants") + MERGED + " SELECT (SELECT count(*) FROM keyed WHERE k IS NOT NULL) AS indexed, (SELECT count(*) FROM keyed WHERE k IS NULL) AS rejected, "
    "count(*) AS documents, count(*) FILTER (description LIKE 'fresh %') AS fresh FROM merged",
)
def upsert_observed(spark, sf_dir):
    """Counts taken while the catalog is written, beside what was written."""
    written, counts = state.upsert_table(restaurants(spark, sf_dir), _batch(spark, sf_dir), ["arrival"], work_path(spark, "catalog"))
    fresh = F.count_if(F.startswith("description", F.lit("fresh ")))
    return written.agg(*(F.lit(counts[c]).cast("bigint").alias(c) for c in ("indexed", "rejected")), F.count("*").alias("documents"), fresh.alias("fresh"))


@query("catalog_rebuild", ctes("restaurants") + MERGED + " SELECT * FROM merged")
def catalog_rebuild(spark, sf_dir):
    return _flat(state.rebuild(_merge(spark, sf_dir), work_path(spark, "snapshot")))


@query(
    "food_seed_load",
    """SELECT p_type AS name_zh, p_name AS name_en, CAST(NULL AS VARCHAR) AS name_pinyin, p_retailprice AS calories_per_100g,
    CASE WHEN p_partkey % 3 = 0 THEN 0e0 ELSE p_size / 2e0 END AS protein_g, 0e0 AS fat_g, p_size * 1e0 AS carb_g,
    CASE WHEN p_partkey % 5 = 0 THEN p_size * 10e0 END AS sodium_mg, CAST(NULL AS DOUBLE) AS fiber_g,
    CASE WHEN p_partkey % 2 = 0 THEN '["vegan","' || p_brand || '"]' ELSE '[]' END AS diet_labels, 'static' AS source, true AS verified FROM part""",
)
def food_seed_load(spark, sf_dir):
    """Foods of the part table, with gaps in the optional values, loaded into an empty target."""
    key = F.col("p_partkey")
    seed = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("name_zh"), F.col("p_name").alias("name_en"), F.col("p_retailprice").alias("calories"),
        F.lit(None).cast("string").alias("name_pinyin"),
        F.when(key % 3 != 0, F.col("p_size") / 2.0).alias("protein_g"), (F.col("p_size") * 1.0).alias("carb_g"),
        F.lit(None).cast("double").alias("fat_g"),
        F.when(key % 5 == 0, F.col("p_size") * 10.0).alias("sodium_mg"), F.lit(None).cast("double").alias("fiber_g"),
        F.when(key % 2 == 0, F.array(F.lit("vegan"), "p_brand")).alias("diet_labels"),
    )
    empty = food_source.seed_rows(spark.createDataFrame([], schemas.FOOD_SEED))
    return food_source.load_seed(empty, seed)


@query(
    "catalog_union",
    ctes("restaurants", "poi_map", "poi_osm") + "SELECT 'catalog' AS source, count(*) AS n FROM restaurants UNION ALL SELECT 'gaode', count(*) FROM poi_map "
    "UNION ALL SELECT 'osm', count(*) FROM poi_osm WHERE coalesce(tag_name, tag_name_zh) IS NOT NULL",
)
def catalog_union(spark, sf_dir):
    from forage.sources import poi
    from workload.poi import features, pois

    own = restaurants(spark, sf_dir).withColumn("source", F.lit("catalog"))
    every = union_sources(own, poi.normalize_pois(pois(spark, sf_dir)), poi.normalize_features(features(spark, sf_dir)))
    return every.groupBy("source").agg(F.count("*").alias("n"))
