"""Portion scaling, reference shares and estimated-nutrition text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.functions.display import fixed_point
from forage.functions.text import squish

AMOUNTS = ["calories_per_100g", "protein_g", "fat_g", "carb_g", "sodium_mg", "fiber_g"]
_ESTIMATE = (
    "name_zh string, name_en string, name_pinyin string, "
    + ", ".join(f"{a} string" for a in AMOUNTS)
    + ", diet_labels array<string>, bad string"
)


def portion(per_100g: Column, grams: Column) -> Column:
    return fixed_point(per_100g * (grams / 100.0)).cast("double")


def reference_share(amount: Column, nutrient: str) -> Column:
    """Whole percent of the daily reference, not capped."""
    return F.floor(amount / fixed.DAILY_REFERENCE[nutrient] * 100 + 0.5).cast("bigint")


def reference_percent(amount: Column, nutrient: str) -> Column:
    return F.least(reference_share(amount, nutrient), F.lit(100).cast("bigint"))


def json_labels(text: Column) -> Column:
    """Label list kept as JSON text; bad or missing text is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def estimate_key(food_name: Column) -> Column:
    return F.lower(squish(food_name))


def parse_estimate(response: Column) -> Column:
    """Stored estimate text -> struct of names, amounts as text and labels; null when it is not a JSON object.

    A surrounding code fence is trimmed first: white space, then the characters
    of the fence mark, then white space again.
    """
    space = F.lit(" \t\n\r")
    body = F.btrim(F.btrim(F.btrim(response, space), F.lit("`json")), space)
    parsed = F.from_json(body, _ESTIMATE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return F.when(body.startswith("{") & parsed["bad"].isNull(), parsed)
