"""Field rules for raw points of interest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forage.functions import fixed

_BLANK = ""


def filled(*choices: Column) -> Column:
    """First choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit(_BLANK)) for c in choices])


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def cuisine_name(raw: Column) -> Column:
    """Display cuisine of the first code; unmapped text stays whole, missing text gets the default."""
    raw = F.coalesce(raw, F.lit(_BLANK))
    code = F.trim(F.split(raw, ";")[0])
    branches = None
    for key, name in fixed.CUISINE_NAMES.items():
        branches = (F if branches is None else branches).when(code == key, F.lit(name))
    return branches.otherwise(filled(raw, F.lit(fixed.DEFAULT_CUISINE)))


def diet_labels(cuisine: Column, tags: Column) -> Column:
    """Labels implied by cuisine substrings, then by explicit diet tags; first-seen order."""
    cuisine = F.coalesce(cuisine, F.lit(_BLANK))
    from_cuisine = [
        F.when(F.contains(cuisine, F.lit(key)), F.lit(label))
        for key, labels in fixed.CUISINE_DIET_LABELS.items()
        for label in labels
    ]
    from_tags = [
        F.when(tag(tags, key).isin("yes", "only"), F.lit(label)) for key, label in fixed.DIET_TAG_LABELS.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*from_cuisine, *from_tags)))


def price_tag(tags: Column) -> Column:
    return F.trim(filled(tag(tags, "price_level"), tag(tags, "level_of_price"))).try_cast("int")


def price_bucket(cost: Column) -> Column:
    """Cost per head -> level 1 to 4; null when it is not a number."""
    amount = F.trim(cost).try_cast("double")
    return (
        F.when(amount.isNull(), F.lit(None).cast("int"))
        .when(amount < 50, 1)
        .when(amount < 100, 2)
        .when(amount < 200, 3)
        .otherwise(4)
    )


def location(text: Column) -> Column:
    """``"lng,lat"`` -> struct; both 0 when either part is not a number."""
    parts = F.split(text, ",")
    lng, lat = (F.trim(F.get(parts, i)).try_cast("double") for i in (0, 1))
    known = lng.isNotNull() & lat.isNotNull()
    return F.struct(
        F.when(known, lat).otherwise(0.0).alias("lat"),
        F.when(known, lng).otherwise(0.0).alias("lng"),
    )


def last_category(path: Column, missing: str) -> Column:
    return F.when(filled(path).isNull(), F.lit(missing)).otherwise(F.element_at(F.split(path, ";"), -1))


def photo_urls(photos: Column, keep: int) -> Column:
    urls = F.filter(F.transform(photos, lambda p: p["url"]), lambda u: u.isNotNull() & (u != _BLANK))
    return F.coalesce(F.slice(urls, 1, keep), F.array().cast("array<string>"))
