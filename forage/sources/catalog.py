"""Catalog reads, labelling and the union of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forage import schemas
from forage.functions import fixed, labels


def read_catalog(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Restaurant documents with the declared layout; no schema inference."""
    return spark.read.schema(schemas.RESTAURANT).format(format).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options) -> DataFrame:
    """Relational table read in parallel slices of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts,
            **options,
        )
        .load()
    )


def label_catalog(documents: DataFrame, rules: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Merge rule labels found in the text into the given labels.

    ``rules`` may replace any of the ``diet``, ``allergen`` and ``allergen_free``
    rule lists.  All rules run in one narrow pass over the text.
    """
    rules = {"diet": fixed.DIET_RULES, "allergen": fixed.ALLERGEN_RULES, "allergen_free": fixed.ALLERGEN_FREE_RULES, **(rules or {})}
    columns = documents.columns
    none = F.array().cast("array<string>")
    tags = F.col("tags") if "tags" in columns else none
    items = F.transform("menu_items", lambda m: m["name"]) if "menu_items" in columns else none
    text = labels.labelling_text(F.col("name"), F.col("description"), F.col("cuisine_type"), tags, F.coalesce(items, none))
    read = documents.withColumn("_text", F.lower(text)).withColumn("_cjk", labels.has_cjk(F.col("_text")))
    inferred = read.withColumns(
        {f"_{kind}": labels.lowered_labels(F.col("_text"), F.col("_cjk"), rules[kind]) for kind in rules}
    )
    merged = inferred.withColumns(
        {
            "diet_labels": labels.merge_labels(F.col("diet_labels"), F.col("_diet")),
            "allergens": labels.merge_labels(F.col("allergens"), F.col("_allergen")),
            "allergen_free": labels.merge_labels(F.col("allergen_free"), F.col("_allergen_free")),
        }
    )
    return merged.withColumn("allergen_free", labels.without(F.col("allergen_free"), F.col("allergens"))).select(*columns)


def union_sources(*catalogs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)
