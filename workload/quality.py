"""Ranking quality over the bound feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.operators import evaluation, guard
from forage.plans.search import search
from workload import sql
from workload.bindings import ctes, profiles, restaurants, view
from workload.registry import query
from workload.requests import requests
from workload.retrieval import SEARCH

JUDGED = ctes("feedback") + ", j AS (SELECT query_id, rank_position, max(CAST(is_relevant AS INT)) AS rel FROM feedback GROUP BY ALL) "
KEYS = ["query_id"]


@query("eval_precision10", JUDGED + "SELECT query_id, round(avg(rel), 6) AS precision_10 FROM j WHERE rank_position <= 10 GROUP BY 1")
def eval_precision10(spark, sf_dir):
    scores = evaluation.precision_at(view(spark, sf_dir, "feedback"), KEYS)
    return scores.select("query_id", F.round("precision_10", 6).alias("precision_10"))


@query(
    "eval_ndcg10",
    JUDGED + """, d AS (SELECT query_id, sum(CASE WHEN rank_position <= 10 THEN rel / log2(rank_position + 1) ELSE 0 END) AS dcg FROM j GROUP BY 1),
    o AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS i FROM j),
    i AS (SELECT query_id, sum(rel / log2(i + 1)) AS best FROM o WHERE i <= 10 GROUP BY 1)
    SELECT query_id, round(CASE WHEN best = 0 THEN 0e0 ELSE dcg / best END, 6) AS ndcg_10 FROM d JOIN i USING (query_id)""",
)
def eval_ndcg10(spark, sf_dir):
    scores = evaluation.ndcg_at(view(spark, sf_dir, "feedback"), KEYS)
    return scores.select("query_id", F.round("ndcg_10", 6).alias("ndcg_10"))


@query(
    "eval_mrr",
    ctes("feedback") + ", f AS (SELECT query_id, min(rank_position) FILTER (is_relevant) AS r FROM feedback GROUP BY 1) SELECT round(avg(coalesce(1e0 / r, 0e0)), 6) AS mrr FROM f",
)
def eval_mrr(spark, sf_dir):
    return evaluation.mean_reciprocal_rank(view(spark, sf_dir, "feedback"), KEYS).select(F.round("mrr", 6).alias("mrr"))


@query(
    "eval_allergen_recall",
    SEARCH + f""", shown AS (SELECT DISTINCT q.user_id, h.restaurant_id, len(h.warning) > 0 AS warned FROM hits h JOIN requests q USING (query_id) WHERE q.user_id IS NOT NULL),
    p AS (SELECT s.user_id, s.restaurant_id, bool_or(s.warned) AS warned, coalesce(bool_or(list_has_any({sql.words('p.allergens')}, {sql.words('r.allergens')})), false) AS flagged
      FROM shown s JOIN restaurants r USING (restaurant_id) LEFT JOIN profiles p USING (user_id) GROUP BY ALL)
    SELECT user_id, count(*) FILTER (flagged AND warned) AS warned, count(*) FILTER (flagged) AS flagged,
    round(count(*) FILTER (flagged AND warned) / nullif(count(*) FILTER (flagged), 0), 6) AS recall FROM p GROUP BY 1""",
)
def eval_allergen_recall(spark, sf_dir):
    """Shown pairs that profile and catalog say need a warning, against the warnings on the hits themselves."""
    catalog, people = restaurants(spark, sf_dir), profiles(spark, sf_dir)
    result = search(requests(spark, sf_dir), catalog, people)
    users = result.requests.filter(F.col("user_id").isNotNull()).select("query_id", "user_id")
    shown = result.hits.join(users, "query_id").groupBy("user_id", "restaurant_id").agg(F.bool_or(F.size("allergen_warning") > 0).alias("warned"))
    flagged = guard.allergen_guard(shown, catalog, people).select("user_id", "restaurant_id", (F.size("triggered") > 0).alias("flagged"))
    scores = evaluation.allergen_recall(shown.join(flagged, ["user_id", "restaurant_id"]), ["user_id"])
    return scores.select("user_id", "warned", "flagged", F.round("recall", 6).alias("recall"))
