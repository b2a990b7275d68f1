"""Join of keywords to the texts that contain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest stretch of text used as a join key.
GRAM = 3


def grams(text: Column, size: Column | int) -> Column:
    """Different stretches of ``size`` characters of a text; none where it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def containing(needs: DataFrame, word: str, places: DataFrame, text: str, place: str, also: dict[str, str]) -> DataFrame:
    """Every need beside every place whose ``text`` contains its ``word``; the columns in ``also`` are equal too.

    The join key of a word is the one of its stretches that the fewest places
    have, so a common opening costs nothing; a word shorter than that is a key
    itself.  An empty word is contained in every text.  ``place`` is the id of a
    place.
    """
    on = [F.col(a) == F.col(b) for a, b in also.items()]
    narrow = places.select(place, text, *also.values())
    keys = narrow.select(place, *also.values(), F.explode(F.flatten(F.array(*(grams(F.col(text), n) for n in range(1, GRAM + 1))))).alias("_key"))
    held = keys.groupBy(*also.values(), "_key").agg(F.count(F.lit(1)).alias("_places"))
    size = F.least(F.char_length(word), F.lit(GRAM))
    words = needs.select(word, *also).distinct()
    parts = words.filter(F.col(word) != "").select(word, *also, F.explode(grams(F.col(word), size)).alias("_part"))
    # A stretch that no place has rules the word out, so inner is enough; the rarest decides.
    # The optimizer takes the exploded stretches to be as small as the places' files; on a merge the driver holds none of them.
    rarity = parts.join(held.hint("merge"), [F.col("_part") == F.col("_key"), *on], "left").groupBy(word, *also)
    rarest = rarity.agg(F.min_by("_part", F.struct(F.coalesce("_places", F.lit(0)), "_part")).alias("_rare"))
    met = rarest.join(keys.hint("merge"), [F.col("_rare") == F.col("_key"), *on]).select(word, *also, place)
    every = words.filter(F.col(word) == "").join(narrow, on).select(word, *also, place) if on else None
    met = met if every is None else met.unionByName(every)
    found = met.join(places, place).filter(F.contains(F.col(text), F.col(word)))
    for a, b in also.items():
        found = found.filter(F.col(a) == F.col(b))
    return needs.join(found, [word, *also])
