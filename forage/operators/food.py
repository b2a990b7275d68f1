"""Food lookup by name prefix, ranked by BM25 over the three name columns.

Ranking follows the public full-text convention for prefix queries: each query
word is a prefix, its frequency in a food is the number of matching words, its
document frequency the number of foods with a match, and a prefix found in more
than half of all foods weighs almost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.operators.topk import top_k

NAMES = ["name_zh", "name_en", "name_pinyin"]
WORD = r"[^\p{L}\p{N}]+"
RARE_FLOOR = 1e-6
SCORE_DIGITS = 6


def name_words(foods: DataFrame) -> DataFrame:
    """(food_id, n_words, word) of every word in a name; a run of CJK characters is one word."""
    text = F.concat_ws(" ", *[F.col(c) for c in NAMES])
    words = F.filter(F.split(F.lower(text), WORD), lambda w: w != "")
    return foods.select("food_id", words.alias("words")).select("food_id", F.size("words").alias("n_words"), F.explode("words").alias("word"))


def query_words(q) -> F.Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(q), WORD), lambda w: w != "")))


def food_search(requests: DataFrame, foods: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, position, food_id, score): the best foods that match any query word as a prefix.

    Requests with the same words are answered once.
    """
    asked = requests.select("query_id", query_words("q").alias("words"))
    prefixes = asked.select("words").distinct().select("words", F.explode("words").alias("prefix"))
    index = name_words(foods)
    asked_words = prefixes.select("prefix").distinct()
    lengths = asked_words.agg(F.collect_set(F.char_length("prefix")).alias("n")).scalar()
    # prefixes meet the distinct words, not the postings; a word offers its openings of
    # the lengths that prefixes have, so only words that match meet one
    words = index.select("word").distinct().withColumn("_lengths", lengths)
    fitting = F.filter("_lengths", lambda n: n <= F.char_length("word"))
    openings = words.select("word", F.explode(F.transform(fitting, lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    expanded = openings.join(asked_words, "prefix", "left_semi")
    # the optimizer takes the exploded words to be as small as the food table's files, and would send them to all tasks by way of the driver
    hits = index.hint("merge").join(expanded, "word").groupBy("prefix", "food_id", "n_words").agg(F.count("*").alias("freq"))
    with_hits = hits.groupBy("prefix").agg(F.count("*").alias("n_hits"))
    size = foods.agg(F.count("*").alias("n")).scalar()
    mean = index.agg((F.count("*") / F.nullif(size, F.lit(0))).alias("avg")).scalar()
    idf = F.log((size - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    idf = F.when(idf <= 0, F.lit(RARE_FLOOR)).otherwise(idf)
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = idf * F.col("freq") * (k1 + 1) / (F.col("freq") + k1 * (1 - b + b * F.col("n_words") / mean))
    scored = (
        hits.join(with_hits, "prefix")
        .withColumn("part", part)
        .join(prefixes, "prefix")
        .groupBy("words", "food_id")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )
    best = top_k(scored, ["words"], [F.desc("score"), F.asc("food_id")], limit, "food_id")
    return asked.join(best, "words").select("query_id", "position", "food_id", "score")


def food_cascade(requests: DataFrame, foods: DataFrame, estimates: DataFrame, limit: int = 10) -> DataFrame:
    """Database hits, else a cached estimate that needs confirmation, else one ``not_found`` row.

    ``estimates`` has one row per ``cache_key``.
    """
    from forage.functions.nutrition import estimate_key

    found = food_search(requests, foods, limit).select(
        "query_id", F.lit("database").alias("source"), F.lit(False).alias("requires_confirm"), "position", "food_id",
        F.lit(None).cast("string").alias("estimate_name"),
    )
    rest = requests.join(found.select("query_id").distinct(), "query_id", "left_anti")
    keyed = rest.withColumn("cache_key", estimate_key(F.col("q"))).join(
        estimates.select("cache_key", F.col("name_zh").alias("estimate_name")), "cache_key", "left"
    )
    estimated = F.col("estimate_name").isNotNull()
    other = keyed.select(
        "query_id",
        F.when(estimated, "llm_estimated").otherwise("not_found").alias("source"),
        estimated.alias("requires_confirm"),
        F.when(estimated, 1).alias("position"),
        F.lit(None).cast("bigint").alias("food_id"),
        "estimate_name",
    )
    return found.unionByName(other)
