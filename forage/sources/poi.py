"""Raw points of interest: selections and normalisation to the restaurant layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forage import schemas
from forage.functions import fixed, poi
from forage.functions.scores import haversine_km
from forage.operators.geo import geo_join, radius_filter
from forage.operators.state import earliest
from forage.operators.topk import top_rows


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Map-feature dump, one JSON element per line."""
    return spark.read.schema(schemas.MAP_FEATURE).json(path)


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """Map-service dump, one JSON element per line."""
    return spark.read.schema(schemas.MAP_POI).json(path)


def normalize_features(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map features -> restaurants; features without any name are dropped.  ``keep`` names input columns to carry along."""
    tags = F.col("tags")
    tag = lambda key: poi.tag(tags, key)
    name = poi.filled(tag("name"), tag("name:zh"), tag("name:en"))
    place = lambda part: F.coalesce(place_of(features, part), F.lit(0.0))
    blank = F.lit("")
    address = F.concat_ws(" ", *[F.nullif(tag(f"addr:{part}"), blank) for part in ("street", "housenumber", "city")])
    return features.withColumn("_name", name).filter(F.col("_name").isNotNull()).select(
        *keep,
        F.concat(F.lit("osm_"), F.coalesce("type", F.lit("node")), F.lit("_"), F.coalesce(F.col("id").cast("string"), blank)).alias("restaurant_id"),
        F.col("_name").alias("name"),
        F.coalesce(tag("description"), blank).alias("description"),
        poi.cuisine_name(tag("cuisine")).alias("cuisine_type"),
        address.alias("address"),
        F.coalesce(poi.filled(tag("phone"), tag("contact:phone")), blank).alias("phone"),
        poi.price_tag(tags).alias("price_level"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("rating_count"),
        F.struct(place("lat").alias("lat"), place("lon").alias("lng")).alias("geo"),
        poi.diet_labels(tag("cuisine"), tags).alias("diet_labels"),
        _none().alias("allergens"),
        _none().alias("allergen_free"),
        F.array(F.coalesce(tag("opening_hours"), blank)).alias("business_hours"),
        _none().alias("images"),
        F.lit("osm").alias("source"),
        F.coalesce(poi.filled(tag("website"), tag("contact:website")), blank).alias("website"),
        _none(f"array<{schemas.MENU_ITEM}>").alias("menu_items"),
    )


def normalize_pois(pois: DataFrame, variant: str = "official", keep: tuple[str, ...] = ()) -> DataFrame:
    """Map-service POIs -> restaurants; ``keep`` names input columns to carry along, such as a merge order."""
    rule = fixed.POI_VARIANTS[variant]
    blank = F.lit("")
    named = pois if rule["keep_unnamed"] else pois.filter(poi.filled(F.col("name")).isNotNull())
    text = lambda column: F.coalesce(F.col(column), blank)
    return named.select(
        *keep,
        F.concat(F.lit(rule["prefix"]), text("id")).alias("restaurant_id"),
        text("name").alias("name"),
        text("tag").alias("description"),
        poi.last_category(F.col("type"), rule["no_category"]).alias("cuisine_type"),
        text("address").alias("address"),
        text("tel").alias("phone"),
        poi.price_bucket(F.col("biz_ext.cost")).alias("price_level"),
        F.trim("biz_ext.rating").try_cast("double").alias("rating"),
        F.lit(None).cast("int").alias("rating_count"),
        poi.location(F.col("location")).alias("geo"),
        _none().alias("diet_labels"),
        _none().alias("allergens"),
        _none().alias("allergen_free"),
        _none().alias("business_hours"),
        poi.photo_urls(F.col("photos"), rule["photos"]).alias("images"),
        F.lit(rule["source"]).alias("source"),
        blank.alias("website"),
        _none(f"array<{schemas.MENU_ITEM}>").alias("menu_items"),
    )


# --- selections over a dump --------------------------------------------------


def place_of(features: DataFrame, part: str) -> Column:
    """``lat`` or ``lon`` of an element: ways and relations come with a centre, nodes with a place of their own."""
    own = F.col(part)
    return F.coalesce(F.col(f"center.{part}"), own) if "center" in features.columns else own


def _of_kind(kinds: dict[str, tuple[str, ...]], amenity: Column) -> Column:
    wanted = F.lit(False)
    for name, types in kinds.items():
        wanted = wanted | ((amenity == name) & F.col("type").isin(list(types)))
    return wanted


def of_kinds(features: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Elements whose amenity and type a selection takes."""
    return features.filter(_of_kind(kinds, poi.tag(F.col("tags"), "amenity")))


def _named_like(features: DataFrame, keyword: str | None) -> DataFrame:
    return features.filter(poi.tag(F.col("tags"), "name").rlike(f"(?i){keyword}")) if keyword else features


def features_around(features: DataFrame, lat: float, lng: float, radius_m: int = 5000, keyword: str | None = None) -> DataFrame:
    """Eating places within a radius, optionally with a name pattern."""
    kept = features.filter(_of_kind(fixed.AROUND_KINDS, poi.tag(F.col("tags"), "amenity")))
    placed = _named_like(kept, keyword).withColumns({"_lat": place_of(features, "lat"), "_lon": place_of(features, "lon")})
    return radius_filter(placed, lat, lng, radius_m / 1000.0, "_lat", "_lon").drop("_lat", "_lon")


def features_in_box(features: DataFrame, box: tuple[float, float, float, float], keyword: str | None = None) -> DataFrame:
    south, west, north, east = box
    inside = place_of(features, "lat").between(south, north) & place_of(features, "lon").between(west, east)
    kept = features.filter(inside & _of_kind(fixed.BOX_KINDS, poi.tag(F.col("tags"), "amenity")))
    return _named_like(kept, keyword)


def city_box(city: str) -> tuple[float, float, float, float]:
    """Box of a city by name, ignoring case; unknown names get the default city."""
    return fixed.CITY_BOXES.get(city.lower(), fixed.CITY_BOXES[fixed.DEFAULT_CITY])


def in_cities(features: DataFrame, requests: DataFrame) -> DataFrame:
    """Features of each requested city; requests are deduplicated to known city names first.

    Every feature is tagged with the few boxes that contain it, so the join is
    on the city name.
    """
    asked = requests.withColumn(
        "resolved",
        F.when(F.lower("city").isin(list(fixed.CITY_BOXES)), F.lower("city")).otherwise(F.lit(fixed.DEFAULT_CITY)),
    ).distinct()
    tagged = in_boxes(of_kinds(features, fixed.BOX_KINDS), place_of(features, "lat"), place_of(features, "lon"), "resolved")
    return tagged.join(asked, "resolved")


def in_boxes(places: DataFrame, lat: Column, lng: Column, name: str = "city") -> DataFrame:
    """Each place once for every city box that holds it."""
    inside = [
        F.when(lat.between(s, n) & lng.between(w, e), F.lit(city))
        for city, (s, w, n, e) in fixed.CITY_BOXES.items()
    ]
    return places.withColumn(name, F.explode(F.array_compact(F.array(*inside))))


def _keyword(pois: DataFrame, keyword: str | None, category: str | None, city: str | None) -> DataFrame:
    """POIs whose name, tag or category holds the keyword, of one category path and one city."""
    if keyword:
        holds = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower())) for c in ("name", "tag", "type")]
        pois = pois.filter(holds[0] | holds[1] | holds[2])
    if category is not None:
        pois = pois.filter(F.startswith("type", F.lit(category)))
    return pois if city is None else pois.filter(F.col("city") == city)


def keyword_page(
    pois: DataFrame, keyword: str, page: int, page_size: int = fixed.POI_VARIANTS["official"]["page"], category: str | None = None, city: str | None = None
) -> DataFrame:
    """One numbered page of matching POIs, in arrival order."""
    found = _keyword(pois, keyword, category, city)
    return found.orderBy("arrival").offset((page - 1) * page_size).limit(page_size)


def around_page(
    pois: DataFrame, lat: float, lng: float, radius_m: int, page: int, page_size: int = fixed.POI_VARIANTS["official"]["page"], keyword: str | None = None, digits: int | None = None
) -> DataFrame:
    """One numbered page of the POIs within a radius, nearest first, with ``km``.

    With ``digits`` distances are rounded to so many; those that are then equal come in arrival order.
    """
    placed = _keyword(pois, keyword, None, None).withColumn("place", poi.location(F.col("location")))
    placed = placed.select("*", "place.lat", "place.lng")
    km = haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    near = radius_filter(placed, lat, lng, radius_m / 1000.0).withColumn("km", km if digits is None else F.round(km, digits))
    return near.orderBy("km", "arrival").offset((page - 1) * page_size).limit(page_size)


def pages_around(pois: DataFrame, requests: DataFrame) -> DataFrame:
    """The asked page of every request: (request_id, position, km and the POI), nearest first.

    ``requests``: request_id, lat, lng, radius_km, page, page_size and keyword
    (null or empty: any).  Requests that ask for the same are answered once.
    They and the places meet in grid cells; a request for one page is the
    one-row case.
    """
    placed = pois.withColumn("_place", poi.location(F.col("location"))).withColumns({"place_lat": F.col("_place.lat"), "place_lng": F.col("_place.lng")}).drop("_place")
    asked = requests.select("request_id", "lat", "lng", "radius_km", "page", "page_size", F.nullif(F.lower("keyword"), F.lit("")).alias("_keyword"))
    own = [c for c in asked.columns if c != "request_id"]
    asked = asked.withColumn("_ask", F.sha2(F.to_json(F.struct(*own)), 256))
    asks = asked.groupBy("_ask").agg(*[F.first(c).alias(c) for c in own])
    met = geo_join(asks, placed)
    holds = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("_keyword")) for c in ("name", "tag", "type")]
    met = met.filter(F.col("_keyword").isNull() | holds[0] | holds[1] | holds[2])
    met = met.withColumn("_last", F.col("page") * F.col("page_size"))
    deepest = requests.agg(F.coalesce(F.max(F.col("page") * F.col("page_size")), F.lit(0))).first()[0]
    ranked = top_rows(met, ["_ask"], [F.asc("km"), F.asc("arrival")], "_last", int(deepest), "arrival")
    asked_page = F.col("position") > F.col("_last") - F.col("page_size")
    pages = ranked.filter(asked_page).drop("_last", *own)
    return asked.select("request_id", "_ask").join(pages, "_ask").drop("_ask")


def first_seen(pois: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First occurrence per source id in crawl order; rows without an id are dropped."""
    return earliest(pois.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], order)
