"""Facet counts and totals over the candidates of every need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.operators.topk import top_k


def facet_keys(facets: list[str]) -> Column:
    """Array of (facet, key) pairs of one document; several facets share one pass."""
    singles = {"price_level": F.col("price_level").cast("string"), "cuisine_type": F.col("cuisine_type")}
    parts = []
    for facet in facets:
        if facet == "diet_labels":
            keys = F.array_distinct(F.coalesce(F.col("diet_labels"), F.array().cast("array<string>")))
        else:
            keys = F.array_compact(F.array(singles[facet]))
        parts.append(F.transform(keys, _named_key(facet)))
    return F.concat(*parts)


def _named_key(facet: str):
    return lambda key: F.struct(F.lit(facet).alias("facet"), key.alias("key"))


def facet_counts(candidates: DataFrame, key: str = "need", sizes: dict[str, int] = fixed.FACET_SIZES) -> DataFrame:
    """(key, facet, facet key, n): the largest buckets per facet, ties by key."""
    counts = (
        # outer, then filtered: the plain form would build the pairs twice to test for emptiness
        candidates.select(key, F.inline_outer(facet_keys(list(sizes))))
        .filter(F.col("key").isNotNull())
        .groupBy(key, "facet", "key")
        .agg(F.count("*").alias("n"))
    )
    best = top_k(counts, [key, "facet"], [F.desc("n"), F.asc("key")], max(sizes.values()), spread_by="key")
    size = F.lit(0)
    for facet, limit in sizes.items():
        size = F.when(F.col("facet") == facet, limit).otherwise(size)
    return best.filter(F.col("position") <= size)


def facet_maps(
    facets: DataFrame, requests: DataFrame | None = None, key: str = "query_id", sizes: dict[str, int] = fixed.FACET_SIZES
) -> DataFrame:
    """One row per query with a map per facet; a map holds at most the facet's bucket limit.

    With the requests, queries without hits get empty maps.
    """
    entry = F.struct("key", "n")
    maps = facets.groupBy(key).agg(
        *[
            F.map_from_entries(F.collect_list(F.when(F.col("facet") == facet, entry))).alias(facet)
            for facet in sizes
        ]
    )
    if requests is None:
        return maps
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,n:bigint>>"))
    every = requests.select(key).join(maps, key, "left")
    return every.select(key, *[F.coalesce(facet, empty).alias(facet) for facet in sizes])


def totals(candidates: DataFrame, key: str = "need") -> DataFrame:
    return candidates.groupBy(key).agg(F.count("*").alias("total"))
