"""Profiles joined to what their users see: allergen cross-checks and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forage.functions.display import allergen_text
from forage.functions.scores import triggered_allergens


def allergen_guard(pairs: DataFrame, catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """Triggered allergens and warning text of every shown (user, restaurant) pair.

    Two key joins on pairs that occur; users and restaurants that merely share
    an allergen are never paired up.
    """
    shown = pairs.select("user_id", "restaurant_id").distinct()
    user = profiles.select("user_id", F.col("allergens").alias("user_allergens"))
    place = catalog.select("restaurant_id", F.col("allergens").alias("present"))
    checked = shown.join(user, "user_id", "left").join(place, "restaurant_id")
    warned = checked.withColumn("triggered", triggered_allergens(F.col("user_allergens"), F.col("present")))
    return warned.select(
        "user_id", "restaurant_id", "triggered", allergen_text(F.col("triggered")).alias("warning")
    )


def profile_or_default(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every user with the stored profile, or an empty one."""
    none = F.array().cast("array<string>")
    return users.select("user_id").join(profiles, "user_id", "left").select(
        "user_id",
        F.coalesce("diet_labels", none).alias("diet_labels"),
        F.coalesce("allergens", none).alias("allergens"),
        "price_pref",
    )


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, area: str) -> DataFrame:
    """Primary rows, plus fallback rows of areas where the primary source has none."""
    covered = primary.select(area).distinct()
    return primary.unionByName(fallback.join(covered, area, "left_anti"), allowMissingColumns=True)
