"""Text shown to people: warnings, distances, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forage.functions import fixed


def fixed_point(value: Column) -> Column:
    """Non-negative number as text with one decimal, rounded on its exact binary value, ties upward.

    Only quarters such as 1.25 are exact ties at one decimal; everything else
    is left to the formatter, which also works on the binary value.
    """
    tie = F.pmod(value * 4, F.lit(2.0)) == 1
    return F.call_function("format_number", F.when(tie, value + 0.01).otherwise(value), F.lit("0.0"))


def named(code: Column, names: dict) -> Column:
    """Display name of a code; unknown codes give null."""
    branches = None
    for key, name in names.items():
        branches = (F if branches is None else branches).when(code == F.lit(key), F.lit(name))
    return branches


def allergen_text(allergens: Column) -> Column:
    return F.array_join(F.transform(allergens, lambda a: F.coalesce(named(a, fixed.ALLERGEN_NAMES), a)), "、")


def distance_text(metres: Column) -> Column:
    """``850m`` below one kilometre, else ``1.2km``; empty when unknown."""
    far = F.concat(fixed_point(metres / 1000.0), F.lit("km"))
    near = F.concat(metres.cast("string"), F.lit("m"))
    return F.when(metres.isNull(), F.lit("")).when(metres < 1000, near).otherwise(far)


def page_number(offset: Column, limit: Column) -> Column:
    return (F.floor(offset / limit) + 1).cast("bigint")
