"""Food seed, stored nutrition estimates and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forage import schemas
from forage.functions import nutrition


def read_seed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of foods, or with ``lines`` one food per line, which splits over many tasks."""
    return spark.read.schema(schemas.FOOD_SEED).json(path, multiLine=not lines)


def seed_rows(seed: DataFrame) -> DataFrame:
    """Seed foods with their defaults; labels are kept as JSON text."""
    zero = F.lit(0.0)
    none = F.array().cast("array<string>")
    return seed.select(
        "name_zh", "name_en", "name_pinyin",
        F.col("calories").alias("calories_per_100g"),
        *[F.coalesce(c, zero).alias(c) for c in ("protein_g", "fat_g", "carb_g")],
        "sodium_mg", "fiber_g",
        F.to_json(F.coalesce("diet_labels", none)).alias("diet_labels"),
        F.lit("static").alias("source"),
        F.lit(True).alias("verified"),
    )


def load_seed(target: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed an empty food table; a table that has rows stays as it is."""
    return seed_rows(seed) if target.limit(1).isEmpty() else target


def estimates(responses: DataFrame) -> DataFrame:
    """Stored estimator answers -> food rows; unusable answers are dropped.

    The asked name stands in for a missing name, 0 for missing amounts.
    """
    # one-element explode: a plain filter on the struct would run the parse a second time
    parsed = responses.withColumn("e", F.array(nutrition.parse_estimate(F.col("response"))))
    parsed = parsed.withColumn("e", F.explode_outer("e")).filter(F.col("e").isNotNull())
    number = lambda name: F.coalesce(F.trim(f"e.{name}").try_cast("double"), F.lit(0.0))
    return parsed.select(
        *[c for c in responses.columns if c != "response"],
        nutrition.estimate_key(F.col("food_name")).alias("cache_key"),
        F.coalesce("e.name_zh", "food_name").alias("name_zh"),
        F.col("e.name_en").alias("name_en"),
        F.col("e.name_pinyin").alias("name_pinyin"),
        *[number(c).alias(c) for c in nutrition.AMOUNTS],
        F.coalesce("e.diet_labels", F.array().cast("array<string>")).alias("diet_labels"),
    )


# --- dictionary files -------------------------------------------------------


def synonym_forms(texts: DataFrame, column: str = "value") -> DataFrame:
    """(form, canonical, forms) from JSON objects of label -> forms; a later entry of a form wins.

    Later means further down in the object, then, across rows, the larger
    ``seq``.
    """
    entries = F.map_entries(F.from_json(F.col(column), "map<string,array<string>>"))
    rows = texts.select("seq", F.posexplode(entries).alias("at", "entry"))
    forms = F.concat(F.array("entry.key"), F.col("entry.value"))
    long = rows.select("seq", "at", F.col("entry.key").alias("canonical"), forms.alias("forms"), F.posexplode(forms).alias("place", "form"))
    chosen = F.max_by(F.struct("canonical", "forms"), F.struct("seq", "at", "place"))
    return long.groupBy(F.lower("form").alias("form")).agg(chosen.alias("c")).select("form", "c.canonical", "c.forms")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Synonym file: one JSON object of label -> forms."""
    return synonym_forms(spark.read.text(path, wholetext=True).withColumn("seq", F.lit(0)))


def read_stopwords(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word): one word per line, trimmed and lower-cased, blank lines dropped."""
    word = F.lower(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.read.text(path).select(F.lit(lang).alias("lang"), word.alias("word")).filter("word <> ''").distinct()
