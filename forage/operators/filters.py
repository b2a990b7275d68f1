"""Catalog filters, point lookups and name completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forage.operators.topk import top_k


def any_label(catalog: DataFrame, labels: list[str]) -> DataFrame:
    """Rows with at least one of the labels; no labels means no filter."""
    return catalog.filter(F.arrays_overlap("diet_labels", F.array(*map(F.lit, labels)))) if labels else catalog


def price_in(catalog: DataFrame, levels: list[int]) -> DataFrame:
    return catalog.filter(F.col("price_level").isin(levels)) if levels else catalog


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the requested keys; unknown keys give nothing, repeated keys one row."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def meal_filter(log: DataFrame, meal: str) -> DataFrame:
    """``all`` keeps every meal."""
    return log if meal == "all" else log.filter(F.col("meal_type") == meal)


def menu_listing(catalog: DataFrame) -> DataFrame:
    """One row per menu item; restaurants without a menu keep one row of nulls."""
    return catalog.select("restaurant_id", F.inline_outer("menu_items"))


def autocomplete(prefixes: DataFrame, catalog: DataFrame, size: int = 8) -> DataFrame:
    """Up to ``size`` distinct names per prefix, ignoring case, in name order.

    A name offers its openings of the lengths that prefixes have and meets them
    on the whole text, so nothing is compared that does not match.  Names are
    cut per opening, in each map task first, before prefixes that differ only
    in case take them.
    """
    asked = prefixes.select("prefix").distinct().filter(F.char_length("prefix") >= 1).withColumn("_key", F.lower("prefix"))
    keys = asked.select("_key").distinct()
    lengths = keys.agg(F.collect_set(F.char_length("_key")).alias("n")).scalar()
    names = catalog.select("name").filter(F.char_length("name") >= 1).distinct().withColumn("_lengths", lengths)
    lowered = F.lower("name")
    fitting = F.filter("_lengths", lambda n: n <= F.char_length(lowered))
    offered = names.select("name", F.explode(F.transform(fitting, lambda n: F.substring(lowered, F.lit(1), n))).alias("_key"))
    best = top_k(offered.join(keys, "_key", "left_semi"), ["_key"], [F.asc("name")], size, "name")
    return asked.join(best, "_key").select("prefix", "name", "position")
