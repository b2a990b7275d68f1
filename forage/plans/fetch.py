"""What a crawl finds: places for a table of needs, capped, in the restaurant layout.

A need is a keyword with or without a place.  With one, the places around it
come from the map service, and from the feature dump where the service has
none; without, from the default city of the feature dump.  Keywords are literal
text, met without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forage.functions import fixed, poi
from forage.functions.text import squish
from forage.operators.geo import geo_join
from forage.operators.guard import primary_or_fallback
from forage.operators.substring import containing
from forage.operators.trigger import ingest_cap
from forage.sources import poi as source

RADIUS_KM, PAGES = 5.0, 2


def needs_of(searches: DataFrame) -> DataFrame:
    """need_id, q, lat and lng of different searches; a place needs both of its numbers."""
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    place = [F.when(placed, F.col(c)).alias(c) for c in ("lat", "lng")]
    return searches.select(need_id(), squish(F.col("q")).alias("q"), *place).distinct()


def need_id() -> Column:
    """Name of a search's need, from its own q, lat and lng, the same in every batch."""
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    place = F.when(placed, F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string")))
    return F.sha2(F.concat_ws("@", F.coalesce(place, F.lit("nogeo")), squish(F.col("q"))), 256).alias("need_id")


def around_map(needs: DataFrame, pois: DataFrame) -> DataFrame:
    """First pages of the map service around each placed need: need_id, position and the restaurant, nearest first.

    Places without id or name are left out; of the others a source id counts once per need, where it comes first.
    """
    pages = PAGES * fixed.POI_VARIANTS["web"]["page"]
    asked = needs.select("need_id", F.lower("q").alias("_q"), "lat", "lng", F.lit(RADIUS_KM).alias("radius_km"))
    placed = pois.withColumn("_at", poi.location(F.col("location"))).withColumns({"place_lat": F.col("_at.lat"), "place_lng": F.col("_at.lng")})
    holds = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("_q")) for c in ("name", "tag", "type")]
    met = geo_join(asked, placed).filter(holds[0] | holds[1] | holds[2])
    nearest = Window.partitionBy("need_id").orderBy("km", "arrival")
    paged = met.withColumn("position", F.row_number().over(nearest)).filter(F.col("position") <= pages)
    paged = paged.filter(F.col("id").isNotNull() & (F.col("id").cast("string") != "") & poi.filled(F.col("name")).isNotNull())
    once = Window.partitionBy("need_id", "id").orderBy("position")
    paged = paged.withColumn("_once", F.row_number().over(once)).filter("_once = 1")
    return source.normalize_pois(paged, "web", keep=("need_id", "position"))


def _features(features: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Eating places of the feature dump as restaurants, with their searched name."""
    kept = source.of_kinds(features, kinds)
    name = poi.tag(F.col("tags"), "name").alias("searched")
    return source.normalize_features(kept.withColumn("searched", name), keep=("searched",)).withColumns({"place_lat": F.col("geo.lat"), "place_lng": F.col("geo.lng")})


def around_features(needs: DataFrame, features: DataFrame) -> DataFrame:
    """Features around each placed need whose name holds the keyword, nearest first."""
    asked = needs.select("need_id", F.lower("q").alias("_q"), "lat", "lng", F.lit(RADIUS_KM).alias("radius_km"))
    met = geo_join(asked, _features(features, fixed.AROUND_KINDS)).filter(F.contains(F.lower("searched"), F.col("_q")))
    order = Window.partitionBy("need_id").orderBy("km", "restaurant_id")
    return met.withColumn("position", F.row_number().over(order)).drop("_q", "lat", "lng", "radius_km", "km", "place_lat", "place_lng", "searched")


def city_features(needs: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each need's ``city`` whose name holds its keyword ``q``, by id."""
    placed = source.in_boxes(_features(features, fixed.BOX_KINDS), F.col("place_lat"), F.col("place_lng"))
    places = placed.withColumn("_name", F.lower("searched"))
    met = containing(needs.select("need_id", F.col("city").alias("_city"), F.lower("q").alias("_q")), "_q", places, "_name", "restaurant_id", {"_city": "city"})
    order = Window.partitionBy("need_id").orderBy("restaurant_id")
    return met.withColumn("position", F.row_number().over(order)).drop("_q", "_city", "city", "_name", "place_lat", "place_lng", "searched")


def documents(needs: DataFrame, pois: DataFrame, features: DataFrame, cap: int = fixed.TRIGGER_INGEST_CAP) -> DataFrame:
    """need_id, position and restaurant of the first ``cap`` places found for every need (need_id, q, lat, lng)."""
    placed = needs.filter(F.col("lat").isNotNull())
    around = primary_or_fallback(around_map(placed, pois), around_features(placed, features), "need_id")
    anywhere = needs.filter(F.col("lat").isNull()).withColumn("city", F.lit(fixed.DEFAULT_CITY))
    found = around.unionByName(city_features(anywhere, features), allowMissingColumns=True)
    return ingest_cap(found.withColumnRenamed("position", "_place"), "need_id", [F.asc("_place"), F.asc("restaurant_id")], "restaurant_id", cap).drop("_place")
