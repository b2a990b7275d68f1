"""Distance and the four ranking signals."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from forage.functions import fixed


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * fixed.EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(chord), F.lit(1.0)))


def distance_m(km: Column) -> Column:
    """Whole metres, half to even."""
    return F.bround(km * 1000, 0).cast("bigint")


def distance_score(km: Column, scale_km: float = fixed.DISTANCE_SCALE_KM) -> Column:
    """Gaussian decay; 0.5 when either position is unknown."""
    return F.when(km.isNull(), F.lit(0.5)).otherwise(F.exp(-F.pow(km / scale_km, 2) / 2))


def rating_score(rating: Column) -> Column:
    share = F.least(F.greatest(rating / 5.0, F.lit(0.0)), F.lit(1.0))
    return F.when(rating.isNull(), F.lit(0.5)).otherwise(share)


def _hits(wanted: Column, present: Column) -> Column:
    return F.coalesce(F.size(F.filter(wanted, lambda x: F.array_contains(present, x))), F.lit(0))


def diet_score(labels: Column, allergens: Column, allergen_free: Column, wanted: Column, avoided: Column) -> Column:
    """+1 per wanted label, +0.5 per avoided allergen declared free, -2 per one present; never below -2."""
    none = F.array().cast("array<string>")
    labels, allergens, allergen_free, wanted, avoided = (
        F.coalesce(c, none) for c in (labels, allergens, allergen_free, wanted, avoided)
    )
    score = _hits(wanted, labels) + 0.5 * _hits(avoided, allergen_free) - 2.0 * _hits(avoided, allergens)
    return F.greatest(score, F.lit(-2.0))


def text_signal(score: Column) -> Column:
    return F.least(F.coalesce(score, F.lit(0.0)) / 10.0, F.lit(1.0))


def weights(sort_mode: Column, modes=fixed.SORT_MODES) -> Column:
    """Weights of a sort mode as a struct; unknown modes use ``default``."""
    signals = ", ".join(f"{s}: double" for s in modes["default"])
    table = F.from_json(F.lit(json.dumps(modes)), f"map<string,struct<{signals}>>")
    return F.coalesce(F.try_element_at(table, sort_mode), F.try_element_at(table, F.lit("default")))


def final_score(sort_mode: Column, text: Column, diet: Column, rating: Column, distance: Column) -> Column:
    w = weights(sort_mode)
    return w["text"] * text_signal(text) + w["diet"] * (diet + 2.0) / 4.0 + w["rating"] * rating + w["distance"] * distance


def triggered_allergens(avoided: Column, present: Column) -> Column:
    """The user's allergens that the restaurant contains, in the user's order."""
    none = F.array().cast("array<string>")
    present = F.coalesce(present, none)
    return F.filter(F.coalesce(avoided, none), lambda a: F.array_contains(present, a))
