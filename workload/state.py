"""Change-log state and crawl triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import fixed
from forage.operators import state, trigger
from workload import sql
from workload.bindings import ctes, table, view
from workload.registry import query

SAVED = ctes("saved_log") + """, u AS (SELECT user_id, restaurant_id, max((ts, event_id)) FILTER (op = 'unsave') AS cut FROM saved_log GROUP BY ALL),
saved AS (SELECT s.user_id, s.restaurant_id, min(ts) AS saved_at FROM saved_log s JOIN u USING (user_id, restaurant_id)
  WHERE op = 'save' AND (cut IS NULL OR (ts, event_id) > cut) GROUP BY ALL)
"""


@query("saved_state", SAVED + "SELECT * FROM saved")
def saved_state(spark, sf_dir):
    return state.saved_state(view(spark, sf_dir, "saved_log"), ["ts", "event_id"])


@query("saved_list", SAVED + "SELECT user_id, restaurant_id, saved_at FROM saved ORDER BY user_id, saved_at DESC")
def saved_list(spark, sf_dir):
    return state.saved_list(state.saved_state(view(spark, sf_dir, "saved_log"), ["ts", "event_id"]))


@query(
    "profile_latest",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS diet_label, arg_max(value, (ts, event_id)) AS price_pref, max(ts) AS updated_at FROM events GROUP BY 1""",
)
def profile_latest(spark, sf_dir):
    """Each event is a profile update; the last write of a user wins whole."""
    updates = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("diet_label"), F.col("value").alias("price_pref"), F.col("ts").alias("updated_at"), "event_id"
    )
    return state.latest(updates, ["user_id"], ["updated_at", "event_id"]).drop("event_id")


@query(
    "feedback_log",
    ctes("feedback") + "SELECT user_id, is_relevant, comment, count(*) AS n, count(rank_position) AS n_ranked FROM (SELECT user_id, rank_position, is_relevant, CAST(NULL AS VARCHAR) AS comment FROM feedback "
    "UNION ALL SELECT NULL, NULL, true, 'bought' FROM events WHERE event_type = 'purchase') GROUP BY ALL",
)
def feedback_log(spark, sf_dir):
    """Ranked feedback, with an appended batch of anonymous comments."""
    batch = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.lit(True).alias("is_relevant"), F.lit("bought").alias("comment")
    )
    log = state.append_feedback(view(spark, sf_dir, "feedback").withColumn("comment", F.lit(None).cast("string")), batch)
    return log.groupBy("user_id", "is_relevant", "comment").agg(F.count("*").alias("n"), F.count("rank_position").alias("n_ranked"))


_KEY = f"concat(replace(substr({sql.squish('q')}, 1, 40), ' ', '_'), ':', CASE WHEN lat IS NULL OR lng IS NULL THEN 'nogeo' ELSE printf('%.3f,%.3f', lat, lng) END)"


@query("trigger_key", ctes("search_log") + f"SELECT event_id, {_KEY} AS key FROM search_log")
def trigger_key(spark, sf_dir):
    log = view(spark, sf_dir, "search_log")
    return log.select("event_id", trigger.trigger_key(F.col("q"), F.col("lat"), F.col("lng")).alias("key"))


def _greedy(ctes_sql, key, lock):
    """Oracle: walk each key's chain with a recursive CTE."""
    return ctes_sql + f""", fires AS (
      SELECT {key} AS k, min(ts) AS ts FROM ev GROUP BY 1
      UNION ALL
      SELECT f.k, (SELECT min(e.ts) FROM ev e WHERE e.{key} = f.k AND e.ts >= f.ts + INTERVAL {lock} SECOND) AS ts FROM fires f WHERE f.ts IS NOT NULL)
    SELECT k AS {key}, ts FROM fires WHERE ts IS NOT NULL"""


_SHORT = f"ev AS (SELECT {_KEY} AS trigger_key, ts FROM search_log WHERE total < 5 AND page_offset = 0 AND q <> '')"


@query("trigger_ttl", _greedy(ctes("search_log").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SHORT, "trigger_key", 300))
def trigger_ttl(spark, sf_dir):
    return trigger.fired(trigger.requests_to_check(view(spark, sf_dir, "search_log")))


@query(
    "search_triggered",
    ctes("search_log").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", " + _SHORT + """, fires AS (
      SELECT trigger_key AS k, min(ts) AS at FROM ev GROUP BY 1
      UNION ALL
      SELECT f.k, (SELECT min(e.ts) FROM ev e WHERE e.trigger_key = f.k AND e.ts >= f.at + INTERVAL 300 SECOND) AS at FROM fires f WHERE f.at IS NOT NULL)
    """ + f"""SELECT event_id, total, total < 5 AND page_offset = 0 AND q <> '' AS underserved, total < 5 AND page_offset = 0 AND q <> '' AND fires.at IS NOT NULL AS triggered
    FROM search_log LEFT JOIN fires ON k = {_KEY} AND fires.at = ts""",
)
def search_triggered(spark, sf_dir):
    """Every search with both flags: too few hits, and the one that starts a crawl."""
    return trigger.with_triggers(view(spark, sf_dir, "search_log")).select("event_id", "total", "underserved", "triggered")


# every event asks for a refresh of one city and keyword
_CITY = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fixed.REFRESH_CITIES)) + " END"
_WORD = f"CASE event_id % {len(fixed.REFRESH_KEYWORDS)} " + " ".join(f"WHEN {i} THEN {sql.quote(w)}" for i, w in enumerate(fixed.REFRESH_KEYWORDS)) + " END"


@query(
    "refresh_due",
    _greedy(f"WITH RECURSIVE ev AS (SELECT concat({_CITY}, '|', {_WORD}) AS refresh_key, ts FROM events)", "refresh_key", 86400),
)
def refresh_due(spark, sf_dir):
    """Refresh requests keyed by city and keyword, here with a lock of one day so that it binds."""
    key = F.col("event_id")
    city = F.element_at(F.array(*map(F.lit, fixed.REFRESH_CITIES)), (key % 5 + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, fixed.REFRESH_KEYWORDS)), (key % len(fixed.REFRESH_KEYWORDS) + 1).cast("int"))
    asked = table(spark, sf_dir, "events").select(F.concat(city, F.lit("|"), word).alias("refresh_key"), "ts")
    return trigger.fired(asked, key="refresh_key", lock_seconds=86400)
