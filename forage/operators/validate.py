"""Row validation: each check adds its name to ``problems``; a valid row has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forage.functions import fixed


def with_problems(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``checks`` maps a problem name to the condition under which a row has it."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]
    return rows.withColumn("problems", F.array_compact(F.array(*found).cast("array<string>")))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their problems)."""
    fine = F.size("problems") == 0
    return checked.filter(fine).drop("problems"), checked.filter(~fine)


def check_profiles(profiles: DataFrame) -> DataFrame:
    domain = F.array(*[F.lit(label) for label in fixed.DIET_LABEL_NAMES])
    return with_problems(
        profiles,
        {
            "diet_labels": F.size(F.array_except("diet_labels", domain)) > 0,
            "price_pref": ~F.col("price_pref").between(1, 4),
        },
    )


def check_diary(entries: DataFrame) -> DataFrame:
    return with_problems(
        entries,
        {
            "quantity_g": F.col("quantity_g").isNull() | (F.col("quantity_g") <= 0),
            "meal_type": F.col("meal_type").isNull() | ~F.col("meal_type").isin(list(fixed.MEAL_NAMES)),
        },
    )


def check_requests(requests: DataFrame) -> DataFrame:
    return with_problems(
        requests,
        {
            "q": F.char_length("q") > 500,
            "lat": ~F.col("lat").between(-90, 90),
            "lng": ~F.col("lng").between(-180, 180),
            "radius_km": ~F.col("radius_km").between(0.1, 50),
            "offset": F.col("offset").isNull() | (F.col("offset") < 0),
            "limit": F.col("limit").isNull() | ~F.col("limit").between(1, 100),
        },
    )
