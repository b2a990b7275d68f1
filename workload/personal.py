"""Scores, warnings and checks that depend on the person looking."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import display, fixed, scores
from forage.operators import guard, state, validate
from forage.plans.search import with_signals
from workload import sql
from workload.bindings import ctes, profiles, restaurants, table, view
from workload.registry import query

# who saw which restaurant, standing where, asking for what
PAIRS = ctes("restaurants", "profiles", "feedback") + f""", pairs AS (SELECT DISTINCT user_id, restaurant_id FROM feedback),
seen AS (SELECT f.user_id, f.restaurant_id, CASE WHEN f.user_id % 4 = 0 THEN NULL ELSE 39.9e0 + (f.user_id % 10) / 100e0 END AS ulat,
  CASE WHEN f.user_id % 4 = 0 THEN NULL ELSE 116.3e0 + (f.user_id % 10) / 100e0 END AS ulng, lat, lng, rating,
  {sql.words('r.diet_labels')} AS dl, {sql.words('r.allergens')} AS al, {sql.words('r.allergen_free')} AS fr,
  {sql.words('p.diet_labels')} AS wanted, {sql.words('p.allergens')} AS avoided,
  CASE f.user_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'diet_first' WHEN 2 THEN 'rating_first' WHEN 3 THEN 'distance_first' ELSE 'other' END AS sort_mode
  FROM pairs f JOIN restaurants r USING (restaurant_id) LEFT JOIN profiles p ON p.user_id = f.user_id),
far AS (SELECT *, CASE WHEN ulat IS NULL THEN NULL ELSE {sql.haversine('ulat', 'ulng', 'lat', 'lng')} END AS km FROM seen)
"""


def _pairs(spark, sf_dir):
    return view(spark, sf_dir, "feedback").select("user_id", "restaurant_id").distinct()


def _seen(spark, sf_dir):
    user = F.col("user_id")
    own = profiles(spark, sf_dir).select("user_id", F.col("diet_labels").alias("labels"), F.col("allergens").alias("user_allergens"))
    places = restaurants(spark, sf_dir).drop("description")
    modes = F.element_at(F.array(*[F.lit(m) for m in ("default", "diet_first", "rating_first", "distance_first", "other")]), (user % 5 + 1).cast("int"))
    rows = _pairs(spark, sf_dir).join(places, "restaurant_id").join(own, "user_id", "left")
    lat, lng = (F.when(user % 4 != 0, base + (user % 10) / 100.0) for base in (39.9, 116.3))
    km = F.when(lat.isNotNull(), scores.haversine_km(lat, lng, F.col("geo.lat"), F.col("geo.lng")))
    return rows.withColumns({"km": km, "sort_mode": modes, "text_score": (user % 13).cast("double")})


@query("haversine", PAIRS + "SELECT user_id, restaurant_id, round(km, 6) AS km, CAST(round_even(km * 1000, 0) AS BIGINT) AS distance_m FROM far")
def haversine(spark, sf_dir):
    return _seen(spark, sf_dir).select("user_id", "restaurant_id", F.round("km", 6).alias("km"), scores.distance_m(F.col("km")).alias("distance_m"))


@query("distance_score", PAIRS + f"SELECT user_id, restaurant_id, round({sql.distance_score('km')}, 6) AS score FROM far")
def distance_score(spark, sf_dir):
    return _seen(spark, sf_dir).select("user_id", "restaurant_id", F.round(scores.distance_score(F.col("km")), 6).alias("score"))


@query("rating_score", ctes("restaurants") + f"SELECT restaurant_id, round({sql.rating_score('rating')}, 6) AS score FROM restaurants")
def rating_score(spark, sf_dir):
    return restaurants(spark, sf_dir).select("restaurant_id", F.round(scores.rating_score(F.col("rating")), 6).alias("score"))


@query("diet_score", PAIRS + f"SELECT user_id, restaurant_id, {sql.diet_score('dl', 'al', 'fr', 'wanted', 'avoided')} AS score FROM far")
def diet_score(spark, sf_dir):
    return with_signals(_seen(spark, sf_dir)).select("user_id", "restaurant_id", F.col("diet_score").alias("score"))


@query(
    "rank_score",
    PAIRS + f"""SELECT user_id, restaurant_id, round(w_text * least((user_id % 13) / 10e0, 1e0) + w_diet * ({sql.diet_score('dl', 'al', 'fr', 'wanted', 'avoided')} + 2e0) / 4e0
    + w_rating * {sql.rating_score('rating')} + w_dist * {sql.distance_score('km')}, 6) AS final_score
    FROM far JOIN {sql.weights()} w ON w.mode = CASE WHEN sort_mode = 'other' THEN 'default' ELSE sort_mode END""",
)
def rank_score(spark, sf_dir):
    return with_signals(_seen(spark, sf_dir)).select("user_id", "restaurant_id", "final_score")


_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.ALLERGEN_NAMES.items()) + "}"
_TRIGGERED = "list_filter(avoided, lambda a: list_contains(al, a))"


@query("allergen_guard", PAIRS + f"SELECT user_id, restaurant_id, array_to_string({_TRIGGERED}, ',') AS triggered FROM far")
def allergen_guard(spark, sf_dir):
    checked = guard.allergen_guard(_pairs(spark, sf_dir), restaurants(spark, sf_dir), profiles(spark, sf_dir))
    return checked.select("user_id", "restaurant_id", F.array_join("triggered", ",").alias("triggered"))


@query("allergen_text", PAIRS + f"SELECT user_id, restaurant_id, array_to_string(list_transform({_TRIGGERED}, lambda a: coalesce({_NAMES}[a], a)), '、') AS warning FROM far WHERE len({_TRIGGERED}) > 0")
def allergen_text(spark, sf_dir):
    checked = guard.allergen_guard(_pairs(spark, sf_dir), restaurants(spark, sf_dir), profiles(spark, sf_dir))
    return checked.filter(F.size("triggered") > 0).select("user_id", "restaurant_id", "warning")


@query(
    "distance_text",
    PAIRS + f""", m AS (SELECT user_id, restaurant_id, CAST(round_even(km * 1000, 0) AS BIGINT) AS d FROM far)
    SELECT user_id, restaurant_id, CASE WHEN d IS NULL THEN '' WHEN d < 1000 THEN d || 'm' ELSE {sql.to_fixed('d / 1000e0')} || 'km' END AS distance FROM m""",
)
def distance_text(spark, sf_dir):
    metres = scores.distance_m(F.col("km"))
    return _seen(spark, sf_dir).select("user_id", "restaurant_id", display.distance_text(metres).alias("distance"))


@query(
    "profile_default",
    ctes("profiles", "feedback") + ", u AS (SELECT DISTINCT user_id * 20 AS user_id FROM feedback) "
    "SELECT u.user_id, coalesce(diet_labels, '') AS diet_labels, coalesce(allergens, '') AS allergens, price_pref FROM u LEFT JOIN profiles USING (user_id)",
)
def profile_default(spark, sf_dir):
    """Active users, some of whom never stored a profile."""
    users = view(spark, sf_dir, "feedback").select((F.col("user_id") * 20).alias("user_id")).distinct()
    filled = guard.profile_or_default(users, profiles(spark, sf_dir))
    return filled.select("user_id", F.array_join("diet_labels", ",").alias("diet_labels"), F.array_join("allergens", ",").alias("allergens"), "price_pref")


@query(
    "saved_flag",
    ctes("feedback", "saved_log") + """, u AS (SELECT user_id, restaurant_id, max((ts, event_id)) FILTER (op = 'unsave') AS cut FROM saved_log GROUP BY ALL),
    live AS (SELECT DISTINCT s.user_id, s.restaurant_id FROM saved_log s JOIN u USING (user_id, restaurant_id) WHERE op = 'save' AND (cut IS NULL OR (ts, event_id) > cut)),
    pairs AS (SELECT DISTINCT user_id, restaurant_id FROM feedback)
    SELECT p.user_id, p.restaurant_id, l.user_id IS NOT NULL AS is_saved FROM pairs p LEFT JOIN live l USING (user_id, restaurant_id)""",
)
def saved_flag(spark, sf_dir):
    saved = state.saved_state(view(spark, sf_dir, "saved_log"), ["ts", "event_id"])
    return state.saved_flag(_pairs(spark, sf_dir), saved)


# --- validation --------------------------------------------------------------

BAD_PROFILES = """, p AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'vegan,paleo' ELSE coalesce(diet_labels, '') END AS diet_labels,
    CASE WHEN user_id % 15 = 0 THEN 7 WHEN user_id % 4 = 1 THEN NULL ELSE price_pref END AS price_pref FROM profiles)"""


@query(
    "validate_profiles",
    ctes("profiles") + BAD_PROFILES + """ SELECT user_id, concat_ws(',', CASE WHEN user_id % 10 = 0 THEN 'diet_labels' END, CASE WHEN user_id % 15 = 0 THEN 'price_pref' END) AS problems FROM p""",
)
def validate_profiles(spark, sf_dir):
    user = F.col("user_id")
    dirty = profiles(spark, sf_dir).withColumns(
        {
            "diet_labels": F.when(user % 10 == 0, F.array(F.lit("vegan"), F.lit("paleo"))).otherwise(F.col("diet_labels")),
            "price_pref": F.when(user % 15 == 0, 7).when(user % 4 == 1, F.lit(None)).otherwise(F.col("price_pref")),
        }
    )
    return validate.check_profiles(dirty).select("user_id", F.array_join("problems", ",").alias("problems"))


# one request per customer, some with slips
REQUEST_SLIPS = """WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 7 = 0 THEN repeat('x', 501) ELSE c_name END AS q,
    CASE c_custkey % 5 WHEN 0 THEN 95e0 WHEN 1 THEN NULL ELSE 39.9e0 END AS lat, CASE c_custkey % 6 WHEN 0 THEN -181e0 ELSE 116e0 END AS lng,
    CASE c_custkey % 8 WHEN 0 THEN 0.05e0 WHEN 1 THEN 50.5e0 ELSE 5e0 END AS radius_km, CAST(c_custkey % 9 - 1 AS INT) AS page_offset, CAST(c_custkey % 103 AS INT) AS page_limit FROM {customer})"""


@query(
    "validate_queries",
    REQUEST_SLIPS.replace("{customer}", "customer")
    + """ SELECT query_id, concat_ws(',', CASE WHEN length(q) > 500 THEN 'q' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' END,
    CASE WHEN lng NOT BETWEEN -180 AND 180 THEN 'lng' END, CASE WHEN radius_km NOT BETWEEN 0.1e0 AND 50 THEN 'radius_km' END,
    CASE WHEN page_offset < 0 THEN 'offset' END, CASE WHEN page_limit NOT BETWEEN 1 AND 100 THEN 'limit' END) AS problems FROM q""",
)
def validate_queries(spark, sf_dir):
    rows = spark.sql(REQUEST_SLIPS + " SELECT * FROM q", customer=table(spark, sf_dir, "customer"))
    rows = rows.withColumnRenamed("page_offset", "offset").withColumnRenamed("page_limit", "limit")
    return validate.check_requests(rows).select("query_id", F.array_join("problems", ",").alias("problems"))
