"""Nutrition diary: day views, totals, portions and reference shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forage.functions import nutrition

KEYS = ["user_id", "log_date"]
TOTALS = {"calories": "calories_kcal", "protein_g": "protein_g", "fat_g": "fat_g", "carb_g": "carb_g"}


def day_entries(log: DataFrame, user_id: int, log_date: str) -> DataFrame:
    """One user's entries of one day in the order they were made."""
    wanted = (F.col("log_date") == F.lit(log_date).cast("date")) & (F.col("user_id") == user_id)
    return log.filter(wanted).orderBy("created_at", "id")


def daily_totals(log: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Sums per user and day; with a table of requested days, days without entries give zeros."""
    sums = log.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(t) for t, c in TOTALS.items()])
    if days is None:
        return sums
    filled = days.select(*KEYS).distinct().join(sums, KEYS, "left")
    return filled.select(*KEYS, *[F.coalesce(t, F.lit(0.0)).alias(t) for t in TOTALS])


def day_view(log: DataFrame) -> DataFrame:
    """Every entry next to the totals of its day (``day_`` columns); days lie together, entries by time within a day.

    One shuffle brings a user's day together; its sums are window sums over it.
    """
    day = Window.partitionBy(*KEYS)
    totals = {f"day_{t}": F.coalesce(F.sum(c).over(day), F.lit(0.0)) for t, c in TOTALS.items()}
    return log.withColumns(totals).sortWithinPartitions(*KEYS, "created_at", "id")


def reference_shares(totals: DataFrame) -> DataFrame:
    """Percent of the daily reference per nutrient, capped at 100 and uncapped."""
    return totals.select(
        *KEYS,
        *[nutrition.reference_percent(F.col(t), t).alias(f"{t}_percent") for t in TOTALS],
        *[nutrition.reference_share(F.col(t), t).alias(f"{t}_share") for t in TOTALS],
    )


def portions(foods: DataFrame, amounts: DataFrame) -> DataFrame:
    """Nutrition of eaten amounts from per-100 g food values."""
    joined = amounts.join(foods, "food_id")
    return joined.select(
        *amounts.columns,
        nutrition.portion(F.col("calories_per_100g"), F.col("quantity_g")).alias("calories"),
        *[nutrition.portion(F.col(c), F.col("quantity_g")).alias(c) for c in ("protein_g", "fat_g", "carb_g")],
    )
