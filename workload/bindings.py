"""Views over the driver tables, as SQL text that both engines accept.

``{documents}``-style names stand for the driver tables.  Arrays are carried as
comma-separated text and split on the Spark side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forage.session import dealt

RESTAURANTS = """
SELECT concat('doc_', CAST(doc_id AS STRING)) AS restaurant_id,
       concat('Kitchen ', source, ' ', lang, ' ', CAST(doc_id % 97 AS STRING)) AS name,
       text AS description, source AS cuisine_type,
       concat(CAST(doc_id % 211 AS STRING), ' rue ', lang, ' street') AS address,
       CAST(doc_id % 4 + 1 AS INT) AS price_level,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 51) / 10e0 END AS rating,
       39.75e0 + (doc_id * 37 % 450) / 1000e0 AS lat,
       116.10e0 + (doc_id * 53 % 600) / 1000e0 AS lng,
       CASE doc_id % 5 WHEN 0 THEN 'vegan,vegetarian' WHEN 1 THEN 'halal' WHEN 2 THEN 'gluten-free,organic'
                       WHEN 3 THEN 'keto,low-carb' ELSE NULL END AS diet_labels,
       CASE doc_id % 6 WHEN 0 THEN 'peanut' WHEN 1 THEN 'dairy,egg' WHEN 2 THEN 'soy'
                       WHEN 3 THEN 'gluten,sesame' ELSE NULL END AS allergens,
       CASE doc_id % 6 WHEN 0 THEN 'gluten' WHEN 2 THEN 'peanut,dairy' WHEN 4 THEN 'soy' ELSE NULL END AS allergen_free
FROM {documents}
"""

# ten items per menu at every scale
MENU_ITEMS = """
SELECT concat('doc_', CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT)) AS restaurant_id, CAST(p_partkey AS STRING) AS item_id,
       p_name AS name, p_retailprice / 10e0 AS price, p_size * 10e0 AS calories,
       CASE p_partkey % 3 WHEN 0 THEN 'vegan' WHEN 1 THEN 'halal' ELSE NULL END AS item_labels
FROM {part}
"""

PROFILES = """
SELECT c_custkey AS user_id,
       CASE c_custkey % 5 WHEN 0 THEN 'vegan' WHEN 1 THEN 'halal,organic' ELSE NULL END AS diet_labels,
       CASE c_custkey % 4 WHEN 0 THEN 'peanut' WHEN 1 THEN 'dairy,soy' WHEN 2 THEN 'egg,gluten' ELSE NULL END AS allergens,
       CAST(c_nationkey % 4 + 1 AS INT) AS price_pref
FROM {customer}
"""

FOOD_ITEMS = """
SELECT p_partkey AS food_id, p_type AS name_zh, p_name AS name_en, p_brand AS name_pinyin,
       p_retailprice / 10e0 AS calories_per_100g, p_size / 2e0 AS protein_g,
       p_size / 4e0 AS fat_g, (p_partkey % 80) / 1e0 AS carb_g
FROM {part}
"""

FOOD_LOG = """
SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user_id, CAST(l_shipdate AS DATE) AS log_date,
       CASE l_linenumber % 4 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner' ELSE 'snack' END AS meal_type,
       l_partkey AS food_id, p_name AS food_name, l_quantity * 10 AS quantity_g,
       p_retailprice / 10e0 * l_quantity / 10e0 AS calories_kcal,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE p_size / 2e0 * l_quantity / 10e0 END AS protein_g,
       p_size / 4e0 * l_quantity / 10e0 AS fat_g, (p_partkey % 80) / 1e0 * l_quantity / 10e0 AS carb_g,
       l_shipdate AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

SAVED_LOG = """
SELECT event_id, user_id, concat('doc_', CAST(event_id % 5 AS STRING)) AS restaurant_id,
       CASE WHEN event_type = 'purchase' THEN 'save' ELSE 'unsave' END AS op, ts
FROM {events} WHERE event_type IN ('purchase', 'error')
"""

# a user's judged list: ranks vary freely within each query id
FEEDBACK = """
SELECT event_id AS id, user_id, user_id % 40 AS query_id,
       concat('doc_', CAST(event_id * 7 % 200 AS STRING)) AS restaurant_id,
       CAST(event_id % 20 + 1 AS INT) AS rank_position, event_type = 'click' AS is_relevant, ts AS created_at
FROM {events} WHERE event_type IN ('click', 'view')
"""

SEARCH_LOG = """
SELECT event_id, event_type AS q, event_id % 12 AS total, CASE WHEN event_id % 3 = 0 THEN 20 ELSE 0 END AS page_offset,
       CASE WHEN user_id % 2 = 0 THEN 39.9e0 + (user_id % 10) / 100e0 END AS lat,
       CASE WHEN user_id % 2 = 0 THEN 116.3e0 + (user_id % 10) / 100e0 END AS lng, ts
FROM {events}
"""

# searches for dishes and places that the dumps may hold, a third of them without a place
CRAVINGS = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tofu' WHEN 1 THEN ' Vegan ' WHEN 2 THEN 'hotpot' WHEN 3 THEN 'supplier#' WHEN 4 THEN 'peanut sauce' ELSE 'missing dish' END AS q,
       event_id % 7 AS total, CASE WHEN event_id % 5 = 0 THEN 20 ELSE 0 END AS page_offset,
       CASE WHEN user_id % 3 <> 0 THEN 39.75e0 + (user_id * 13 % 45) / 100e0 END AS lat,
       CASE WHEN user_id % 3 <> 0 THEN 116.10e0 + (user_id * 7 % 60) / 100e0 END AS lng, ts
FROM {events}
"""

# odd multiples of 4 reuse the id of the preceding multiple of 8
POI_MAP = """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey - s_suppkey % 8 ELSE s_suppkey END AS id, s_suppkey AS arrival,
       CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS name,
       CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('catering;dining;', CASE s_nationkey % 3 WHEN 0 THEN 'vegan' WHEN 1 THEN 'hotpot' ELSE 'noodles' END) END AS type,
       CASE WHEN s_suppkey % 9 = 0 THEN 'bad' ELSE concat('116.', CAST(100 + s_suppkey % 600 AS STRING), ',39.', CAST(750 + s_suppkey % 200 AS STRING)) END AS location,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat(CAST(s_suppkey % 5 AS STRING), '.', CAST(s_suppkey % 10 AS STRING)) END AS rating,
       CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 13 % 300 AS STRING) END AS cost,
       CASE WHEN s_suppkey % 3 = 0 THEN 'peanut sauce, gluten free' ELSE 'house tofu' END AS tag,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('u', CAST(s_suppkey AS STRING)) ELSE '' END AS photo
FROM {supplier}
"""

POI_OSM = """
SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'way' ELSE 'node' END AS type,
       CASE s_suppkey % 4 WHEN 0 THEN 'cafe' WHEN 1 THEN 'fast_food' ELSE 'restaurant' END AS tag_amenity,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS tag_name,
       CASE WHEN s_suppkey % 22 = 0 THEN concat('zh ', s_name) ELSE NULL END AS tag_name_zh,
       CASE s_nationkey % 5 WHEN 0 THEN 'vegan;regional' WHEN 1 THEN 'chinese' WHEN 2 THEN 'halal' WHEN 3 THEN 'fusion;tapas' ELSE NULL END AS tag_cuisine,
       CASE s_suppkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'only' WHEN 2 THEN 'no' ELSE NULL END AS tag_diet_vegetarian,
       CASE s_suppkey % 7 WHEN 0 THEN 'yes' ELSE NULL END AS tag_diet_gluten_free,
       CASE s_suppkey % 3 WHEN 0 THEN '2' WHEN 1 THEN 'cheap' ELSE NULL END AS tag_price_level,
       CASE s_suppkey % 2 WHEN 0 THEN concat('street ', CAST(s_suppkey AS STRING)) ELSE NULL END AS tag_street,
       39.75e0 + (s_suppkey * 37 % 450) / 1000e0 AS lat, 116.10e0 + (s_suppkey * 53 % 600) / 1000e0 AS lon
FROM {supplier}
"""

# user turns of the conversations, opened with a diet phrase, as a growing query log
QUERY_LOG = """
SELECT conv_id * 1000 + turn AS query_id,
       concat(CASE conv_id % 8 WHEN 0 THEN 'Vegn low-carb food, ' WHEN 1 THEN 'halal and Keto ' WHEN 2 THEN 'gluten free '
              WHEN 3 THEN 'ketogenic veggie organc ' WHEN 4 THEN 'protien rich ' WHEN 5 THEN 'Vegan halal VEGAN '
              ELSE '' END, text) AS q,
       CASE conv_id % 3 WHEN 0 THEN 'halal,vegan' WHEN 1 THEN 'organic' ELSE NULL END AS requested
FROM {conversations} WHERE role = 'user'
"""

# CJK query texts carried by part names
CJK_LOG = """
SELECT p_partkey AS query_id,
       concat(CASE p_partkey % 5 WHEN 0 THEN '附近的素食餐厅' WHEN 1 THEN '无麸质面食' WHEN 2 THEN '清真火锅 好' WHEN 3 THEN '低碳水' ELSE '' END,
              ' ', p_name) AS q
FROM {part}
"""

# stored answers of the nutrition estimator, one per (food name, time)
RESPONSES = """
SELECT event_id, ts,
       concat(CASE user_id % 3 WHEN 0 THEN ' Snack ' WHEN 1 THEN 'snack ' ELSE 'Drink ' END, CAST(user_id % 50 AS STRING)) AS food_name,
       CASE WHEN event_id % 17 = 0 THEN 'sorry'
            ELSE concat(CASE WHEN event_id % 2 = 0 THEN '```json ' ELSE '' END,
                        '{{"name_zh":"f', CAST(user_id AS STRING), '","calories_per_100g":', CAST(event_id % 500 AS STRING),
                        CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"protein_g":', CAST(event_id % 40 AS STRING)) END,
                        ',"diet_labels":["vegan"]}}',
                        CASE WHEN event_id % 2 = 0 THEN ' ```' ELSE '' END) END AS response
FROM {events} WHERE event_type = 'view'
"""

# whole document texts followed by a menu remark, so that label rules of every kind fire
LABEL_TEXTS = """
SELECT concat('doc_', CAST(doc_id AS STRING)) AS restaurant_id, concat('Kitchen ', source) AS name,
       concat(text, ' ', CASE doc_id % 11 WHEN 0 THEN 'Peanut sauce and Egg' WHEN 1 THEN 'gluten-free tofu, low carb'
              WHEN 2 THEN '清真 素食 豆腐' WHEN 3 THEN 'nut.free, soy-free; High-Protein' WHEN 4 THEN 'Wheat, dairy free cheese'
              WHEN 5 THEN '无麸质 有机 芝麻' WHEN 6 THEN 'keto plant-based kosher' ELSE '' END) AS description,
       source AS cuisine_type,
       CASE doc_id % 5 WHEN 0 THEN 'vegan,vegetarian' WHEN 1 THEN 'halal' ELSE NULL END AS diet_labels,
       CASE doc_id % 6 WHEN 0 THEN 'peanut' WHEN 1 THEN 'dairy,egg' ELSE NULL END AS allergens,
       CASE doc_id % 6 WHEN 0 THEN 'gluten' WHEN 2 THEN 'peanut,dairy' ELSE NULL END AS allergen_free
FROM {documents}
"""

VIEWS = {
    "label_texts": LABEL_TEXTS,
    "restaurants": RESTAURANTS,
    "menu_items": MENU_ITEMS,
    "profiles": PROFILES,
    "food_items": FOOD_ITEMS,
    "food_log": FOOD_LOG,
    "saved_log": SAVED_LOG,
    "feedback": FEEDBACK,
    "search_log": SEARCH_LOG,
    "cravings": CRAVINGS,
    "poi_map": POI_MAP,
    "poi_osm": POI_OSM,
    "query_log": QUERY_LOG,
    "cjk_log": CJK_LOG,
    "responses": RESPONSES,
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **streams: DataFrame) -> DataFrame:
    """A bound view; ``streams`` may replace a driver table by a streaming read of it."""
    sql = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", sql))
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in used if t not in streams}
    for t, source in files.items():
        sql = sql.replace("{" + t + "}", source)
    if any(t in streams for t in used):
        return spark.sql(sql, **{t: streams[t] for t in used if t in streams})
    return spark.sql(sql.replace("{{", "{").replace("}}", "}"))


def words(column: str) -> F.Column:
    """Comma text -> array, null -> empty."""
    return F.coalesce(F.split(column, ","), F.array().cast("array<string>"))


def ctes(*names: str) -> str:
    """``WITH`` text of the named views for the oracle engine."""
    return "WITH " + ",\n".join(f"{n} AS ({_plain(VIEWS[n])})" for n in names)


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}")


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound catalog in the restaurant layout."""
    rows = view(spark, sf_dir, "restaurants", documents=dealt(table(spark, sf_dir, "documents")))
    return rows.select(
        "restaurant_id", "name", "description", "cuisine_type", "address", "price_level", "rating",
        F.struct("lat", "lng").alias("geo"),
        words("diet_labels").alias("diet_labels"),
        words("allergens").alias("allergens"),
        words("allergen_free").alias("allergen_free"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "profiles").select(
        "user_id", words("diet_labels").alias("diet_labels"), words("allergens").alias("allergens"), "price_pref"
    )
