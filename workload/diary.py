"""Nutrition diary and food lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import nutrition
from forage.operators import diary, filters, food, state, validate
from forage.sources import food as food_source
from workload import sql
from workload.bindings import ctes, table, view
from workload.registry import query

LOG = ctes("food_log")
_SUMS = ", ".join(
    f"round(coalesce(sum({c}), 0e0), 4) AS {t}" for t, c in diary.TOTALS.items()
)


def _log(spark, sf_dir):
    return view(spark, sf_dir, "food_log")


def _rounded(frame, *keep):
    return frame.select(*keep, *[F.round(t, 4).alias(t) for t in diary.TOTALS])


@query("diary_day", LOG + "SELECT id, meal_type, food_id, quantity_g, created_at FROM food_log WHERE user_id = 150 AND log_date = DATE '1999-05-06'")
def diary_day(spark, sf_dir):
    return diary.day_entries(_log(spark, sf_dir), 150, "1999-05-06").select("id", "meal_type", "food_id", "quantity_g", "created_at")


@query("diary_meal", LOG + "SELECT id, user_id, meal_type FROM food_log WHERE meal_type = 'lunch'")
def diary_meal(spark, sf_dir):
    return filters.meal_filter(_log(spark, sf_dir), "lunch").select("id", "user_id", "meal_type")


@query("daily_totals", LOG + f", s AS (SELECT user_id, log_date, {_SUMS} FROM food_log GROUP BY ALL), "
    "days AS (SELECT DISTINCT c_custkey AS user_id, DATE '1995-03-02' + CAST(c_custkey % 30 AS INT) AS log_date FROM customer UNION SELECT DISTINCT user_id, log_date FROM food_log) "
    "SELECT user_id, log_date, coalesce(calories, 0e0) AS calories, coalesce(protein_g, 0e0) AS protein_g, coalesce(fat_g, 0e0) AS fat_g, coalesce(carb_g, 0e0) AS carb_g FROM days LEFT JOIN s USING (user_id, log_date)")
def daily_totals(spark, sf_dir):
    """Every logged day, and one asked-for day per customer that is mostly empty."""
    log = _log(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.date_add(F.lit("1995-03-02").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("log_date"),
    )
    return _rounded(diary.daily_totals(log, asked.unionByName(log.select("user_id", "log_date"))), "user_id", "log_date")


@query("diary_day_view", LOG + f", s AS (SELECT user_id, log_date, {_SUMS} FROM food_log GROUP BY ALL) "
    "SELECT f.user_id, f.log_date, id, meal_type, food_name, created_at, s.calories, s.protein_g, s.fat_g, s.carb_g FROM food_log f JOIN s USING (user_id, log_date)")
def diary_day_view(spark, sf_dir):
    days = diary.day_view(_log(spark, sf_dir))
    return days.select(
        "user_id", "log_date", "id", "meal_type", "food_name", "created_at",
        *[F.round(f"day_{t}", 4).alias(t) for t in diary.TOTALS],
    )


@query(
    "dri_percent",
    LOG + ", s AS (SELECT user_id, log_date, " + ", ".join(f"round(coalesce(sum({c}), 0e0), 4) AS {t}" for t, c in diary.TOTALS.items()) + " FROM food_log GROUP BY ALL) "
    "SELECT user_id, log_date, "
    + ", ".join(f"least(CAST(floor({t} / {m} * 100 + 0.5e0) AS BIGINT), 100) AS {t}_percent, CAST(floor({t} / {m} * 100 + 0.5e0) AS BIGINT) AS {t}_share" for t, m in (("calories", 2000), ("protein_g", 60), ("fat_g", 65), ("carb_g", 300)))
    + " FROM s",
)
def dri_percent(spark, sf_dir):
    return diary.reference_shares(_rounded(diary.daily_totals(_log(spark, sf_dir)), "user_id", "log_date"))


@query(
    "portion_nutrition",
    ctes("food_items", "food_log") + "SELECT l.id, l.food_id, l.quantity_g, "
    + ", ".join(f"CAST({sql.to_fixed(f'{c} * (l.quantity_g / 100e0)')} AS DOUBLE) AS {n}" for n, c in (("calories", "calories_per_100g"), ("protein_g", "f.protein_g"), ("fat_g", "f.fat_g"), ("carb_g", "f.carb_g")))
    + " FROM food_log l JOIN food_items f USING (food_id)",
)
def portion_nutrition(spark, sf_dir):
    return diary.portions(view(spark, sf_dir, "food_items"), _log(spark, sf_dir).select("id", "food_id", "quantity_g"))


@query(
    "validate_diary",
    LOG + "SELECT id, concat_ws(',', CASE WHEN id % 50 = 1 THEN 'quantity_g' END, CASE WHEN id % 70 = 2 THEN 'meal_type' END) AS problems FROM food_log WHERE id % 50 = 1 OR id % 70 = 2",
)
def validate_diary(spark, sf_dir):
    """Entries with injected slips; the quarantined side."""
    key = F.col("id")
    dirty = _log(spark, sf_dir).withColumns(
        {"quantity_g": F.when(key % 50 == 1, 0.0).otherwise(F.col("quantity_g")), "meal_type": F.when(key % 70 == 2, "brunch").otherwise(F.col("meal_type"))}
    )
    _, quarantined = validate.split_valid(validate.check_diary(dirty))
    return quarantined.select("id", F.array_join("problems", ",").alias("problems"))


@query(
    "diary_state",
    LOG + "SELECT id, user_id FROM food_log WHERE NOT (id % 9 = 0)",
)
def diary_state(spark, sf_dir):
    """Every ninth entry is deleted by its owner; deletes by strangers change nothing."""
    log = _log(spark, sf_dir)
    own = log.filter("id % 9 = 0").select("id", "user_id")
    strangers = log.filter("id % 9 = 1").select("id", (F.col("user_id") + 1).alias("user_id"))
    return state.apply_deletes(log, own.unionByName(strangers)).select("id", "user_id")


@query(
    "food_labels_json",
    "SELECT p_partkey AS food_id, CASE p_partkey % 4 WHEN 0 THEN 'vegan,' || p_brand ELSE '' END AS labels FROM part",
)
def food_labels_json(spark, sf_dir):
    """Label text as stored: good JSON, an empty list, broken text, nothing."""
    key = F.col("p_partkey")
    stored = F.when(key % 4 == 0, F.to_json(F.array(F.lit("vegan"), "p_brand"))).when(key % 4 == 1, "[]").when(key % 4 == 2, "[broken")
    return table(spark, sf_dir, "part").select(
        key.alias("food_id"), F.array_join(nutrition.json_labels(stored), ",").alias("labels")
    )


# --- food search -------------------------------------------------------------

FOOD_QUERIES = [
    (0, "small ring"), (1, "wid"), (2, "re gad"), (3, "Brand#1"), (4, "econ smal"), (5, "zebra"), (6, "blue bolt std"), (7, "p"),
    (8, "snack 12"), (9, "Drink 3 xx"), (10, "qqq 7"),
]


# one lookup per supplier beside the literal ones
FOOD_ASKED = """
SELECT 100 + s_suppkey AS query_id, CASE s_suppkey % 7 WHEN 0 THEN concat('brand#', CAST(s_suppkey % 5 + 1 AS STRING)) WHEN 1 THEN 'econ' WHEN 2 THEN concat('Snack ', CAST(s_suppkey % 50 AS STRING))
       WHEN 3 THEN 'blue b' WHEN 4 THEN 'std pl' WHEN 5 THEN concat('zz', CAST(s_suppkey AS STRING)) ELSE 'promo ring' END AS q
FROM {supplier}
"""


def _queries_sql():
    literal = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in FOOD_QUERIES) + ") v(query_id, q)"
    return f"fq AS ({literal} UNION ALL {FOOD_ASKED.format(supplier='supplier')})"


FOOD_SEARCH = ctes("food_items", "responses") + ", " + _queries_sql() + r""",
fw AS (SELECT food_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name_zh, name_en, name_pinyin)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM food_items),
ix AS (SELECT food_id, len(ws) AS n_words, unnest(ws) AS word FROM fw),
px AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(q), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS prefix FROM fq),
ph AS (SELECT prefix, food_id, n_words, count(*) AS freq FROM (SELECT DISTINCT prefix FROM px) JOIN ix ON starts_with(word, prefix) GROUP BY ALL),
nh AS (SELECT prefix, count(*) AS n_hits FROM ph GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM food_items) AS n, (SELECT count(*) FROM ix) / (SELECT count(*) FROM food_items) AS mean),
sc AS (SELECT query_id, food_id, round(sum(CASE WHEN ln((n - n_hits + 0.5e0) / (n_hits + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - n_hits + 0.5e0) / (n_hits + 0.5e0)) END
  * freq * 2.2e0 / (freq + 1.2e0 * (0.25e0 + 0.75e0 * n_words / mean))), 6) AS score FROM px JOIN ph USING (prefix) JOIN nh USING (prefix), tot GROUP BY ALL),
found AS (SELECT query_id, food_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, food_id) AS INT) AS position FROM sc)
"""


def _food_queries(spark, sf_dir):
    asked = spark.sql(FOOD_ASKED, supplier=table(spark, sf_dir, "supplier"))
    return spark.createDataFrame(FOOD_QUERIES, "query_id bigint, q string").unionByName(asked)


@query("food_search", FOOD_SEARCH + "SELECT query_id, food_id, score, position FROM found WHERE position <= 10")
def food_search(spark, sf_dir):
    return food.food_search(_food_queries(spark, sf_dir), view(spark, sf_dir, "food_items"))


ASOF = "2024-01-20 00:00:00"
# usable answers no older than seven days, the newest per key
CACHE = f""", ok AS (SELECT event_id, ts, food_name, lower({sql.squish('food_name')}) AS cache_key,
    TRY_CAST(trim(replace(replace(response, '```json', ''), '```', '')) AS JSON) AS j FROM responses),
est AS (SELECT event_id, ts, food_name, cache_key, coalesce(j->>'name_zh', food_name) AS name_zh, coalesce(CAST(j->>'calories_per_100g' AS DOUBLE), 0e0) AS calories_per_100g,
    coalesce(CAST(j->>'protein_g' AS DOUBLE), 0e0) AS protein_g, 'vegan' AS diet_labels FROM ok WHERE j IS NOT NULL),
cache AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) AS rn FROM est
    WHERE ts <= TIMESTAMP '{ASOF}' AND ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY) WHERE rn = 1)
"""


def _estimates(spark, sf_dir):
    return food_source.estimates(view(spark, sf_dir, "responses"))


def _cache(spark, sf_dir):
    return state.fresh_estimates(_estimates(spark, sf_dir), F.lit(ASOF).cast("timestamp_ntz"), 7)


@query("nutrition_responses", ctes("responses") + CACHE + "SELECT event_id, cache_key, name_zh, calories_per_100g, protein_g, diet_labels FROM est")
def nutrition_responses(spark, sf_dir):
    return _estimates(spark, sf_dir).select(
        "event_id", "cache_key", "name_zh", "calories_per_100g", "protein_g", F.array_join("diet_labels", ",").alias("diet_labels")
    )


@query("nutrition_cache", ctes("responses") + CACHE + "SELECT cache_key, event_id, name_zh, calories_per_100g FROM cache")
def nutrition_cache(spark, sf_dir):
    return _cache(spark, sf_dir).select("cache_key", "event_id", "name_zh", "calories_per_100g")


@query(
    "food_cascade",
    FOOD_SEARCH + CACHE + f"""SELECT query_id, 'database' AS source, false AS requires_confirm, position, food_id, CAST(NULL AS VARCHAR) AS estimate_name FROM found WHERE position <= 10
    UNION ALL SELECT query_id, CASE WHEN c.cache_key IS NULL THEN 'not_found' ELSE 'llm_estimated' END, c.cache_key IS NOT NULL, CASE WHEN c.cache_key IS NOT NULL THEN 1 END, NULL, c.name_zh
    FROM fq LEFT JOIN cache c ON c.cache_key = lower({sql.squish('q')}) WHERE query_id NOT IN (SELECT query_id FROM found)""",
)
def food_cascade(spark, sf_dir):
    return food.food_cascade(_food_queries(spark, sf_dir), view(spark, sf_dir, "food_items"), _cache(spark, sf_dir))


@query(
    "food_confirm",
    ctes("food_items", "responses") + CACHE + """SELECT food_id, name_zh, name_en, name_pinyin, calories_per_100g, protein_g, fat_g, carb_g,
      CAST(NULL AS DOUBLE) AS sodium_mg, CAST(NULL AS DOUBLE) AS fiber_g, CAST(NULL AS VARCHAR) AS diet_labels, CAST(NULL AS BOOLEAN) AS verified FROM food_items
    UNION ALL SELECT (SELECT max(food_id) FROM food_items) + row_number() OVER (ORDER BY ts, event_id), name_zh, NULL, NULL, calories_per_100g, protein_g,
      coalesce(TRY_CAST(j->>'fat_g' AS DOUBLE), 0e0), coalesce(TRY_CAST(j->>'carb_g' AS DOUBLE), 0e0), coalesce(TRY_CAST(j->>'sodium_mg' AS DOUBLE), 0e0), coalesce(TRY_CAST(j->>'fiber_g' AS DOUBLE), 0e0), diet_labels, true
    FROM (SELECT est.*, ok.j FROM est JOIN ok USING (event_id))""",
)
def food_confirm(spark, sf_dir):
    """All usable estimates are confirmed, with all their amounts and labels, in the order they came."""
    confirmed = _estimates(spark, sf_dir).select("name_zh", "name_en", "name_pinyin", *nutrition.AMOUNTS, "diet_labels", "ts", "event_id")
    stored = state.confirm_estimates(view(spark, sf_dir, "food_items"), confirmed, "ts", "event_id")
    names = ["food_id", "name_zh", "name_en", "name_pinyin", *nutrition.AMOUNTS]
    return stored.select(*names, F.array_join("diet_labels", ",").alias("diet_labels"), "verified")
