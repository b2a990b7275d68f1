"""Ranking quality from judged results.

Input rows are (query keys, rank_position, is_relevant); several judgements of
one rank count as one, relevant when any of them is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged_ranks(feedback: DataFrame, keys: list[str]) -> DataFrame:
    return feedback.groupBy(*keys, "rank_position").agg(F.max(F.col("is_relevant").cast("int")).alias("rel"))


def precision_at(feedback: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Share of relevant results among the judged ranks up to ``k``."""
    top = judged_ranks(feedback, keys).filter(F.col("rank_position") <= k)
    return top.groupBy(*keys).agg(F.avg("rel").alias(f"precision_{k}"))


def ndcg_at(feedback: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Discounted gain over the best possible gain of the judged list; 0 when nothing is relevant.

    Relevance is 0 or 1, so the ideal order follows from the number of relevant
    ranks and no list is ever sorted.
    """
    rank = F.col("rank_position")
    gain = F.when(rank <= k, F.col("rel") / F.log2(rank + 1))
    sums = judged_ranks(feedback, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), F.sum("rel").alias("n_rel")
    )
    places = F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda total, i: total + 1.0 / F.log2(i + 1))
    return sums.select(*keys, F.when(F.col("n_rel") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias(f"ndcg_{k}"))


def reciprocal_rank(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """1 / rank of the first relevant result, 0 without one."""
    first = F.min(F.when(F.col("is_relevant"), F.col("rank_position")))
    return feedback.groupBy(*keys).agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def mean_reciprocal_rank(feedback: DataFrame, keys: list[str]) -> DataFrame:
    return reciprocal_rank(feedback, keys).agg(F.avg("reciprocal_rank").alias("mrr"))


def allergen_recall(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of flagged (user, restaurant) pairs that carried a warning; null when none is flagged."""
    flagged, warned = F.col("flagged"), F.col("warned")
    hit, all_flagged = F.count_if(flagged & warned), F.count_if(flagged)
    totals = (pairs.groupBy(*keys) if keys else pairs).agg(hit.alias("warned"), all_flagged.alias("flagged"))
    return totals.withColumn("recall", F.col("warned") / F.nullif(F.col("flagged"), F.lit(0)))
