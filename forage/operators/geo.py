"""Radius and box predicates, and the grid join between requests and places.

The grid has levels: level m cuts the globe into ``2 ** m`` columns and half as
many rows.  A circle is covered on the level whose cells are at least a quarter
as wide as the circle, so by at most 36 of them whatever its radius, and a
place offers its cell of each level that some circle uses.  What a circle meets
is then close to what it holds, also in a crowded place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.functions.scores import haversine_km

#: Finest level: cells of about 40 m.
FINEST = 20
_SLACK = 1e-9


def reach(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """Latitude and longitude half-widths, in degrees, of a box that holds the circle."""
    angle = radius_km / fixed.EARTH_RADIUS_KM
    dlat = F.degrees(angle) + _SLACK
    ratio = F.sin(angle) / F.cos(F.radians(lat))
    dlng = F.when((F.abs(lat) + dlat < 90) & (F.abs(ratio) <= 1), F.degrees(F.asin(ratio)) + _SLACK).otherwise(180.0)
    return dlat, dlng


def lng_gap(a: Column, b: Column) -> Column:
    """Absolute longitude difference across the date line."""
    return F.abs(F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0)


def within(lat: Column, lng: Column, radius_km: Column, place_lat: Column, place_lng: Column) -> Column:
    """Cheap box test first, exact great-circle distance after it."""
    dlat, dlng = reach(lat, radius_km)
    box = place_lat.between(lat - dlat, lat + dlat) & (lng_gap(lng, place_lng) <= dlng)
    return box & (haversine_km(lat, lng, place_lat, place_lng) <= radius_km)


def level_of(lat: Column, radius_km: Column) -> Column:
    """Level on which a circle is covered."""
    dlat, dlng = reach(lat, radius_km)
    level = F.floor(F.log2(720.0 / F.greatest(dlat, dlng)))
    return F.least(F.greatest(level, F.lit(1)), F.lit(FINEST)).cast("int")


def _columns(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _row(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90.0) * _columns(level) / 360.0)


def _column(lng: Column, level: Column) -> Column:
    return F.floor((lng + 180.0) * _columns(level) / 360.0)


def _cell(level: Column, row: Column, column: Column) -> Column:
    """One number for level, row and column; columns wrap at the date line."""
    wrapped = F.pmod(column, _columns(level).cast("bigint"))
    return (row * (1 << FINEST) + wrapped) * 32 + level


def cells_of(lat: Column, lng: Column, levels: Column) -> Column:
    """A place's cell of each level."""
    return F.transform(levels, lambda m: _cell(m, _row(lat, m), _column(lng, m)))


def cells_around(lat: Column, lng: Column, radius_km: Column) -> Column:
    """All cells of the circle's level that it can touch, each once."""
    dlat, dlng = reach(lat, radius_km)
    level = level_of(lat, radius_km)
    rows = F.sequence(_row(F.greatest(lat - dlat, F.lit(-90.0)), level), _row(F.least(lat + dlat, F.lit(90.0)), level))
    columns = F.sequence(_column(lng - dlng, level), _column(lng + dlng, level))
    return F.flatten(F.transform(rows, lambda r: F.array_distinct(F.transform(columns, lambda c: _cell(level, r, c)))))


def levels_in(requests: DataFrame, lat: str = "lat", radius_km: str = "radius_km") -> Column:
    """The levels that placed requests use, at most ``FINEST``, as a value for every row."""
    return requests.filter(F.col(lat).isNotNull()).agg(F.collect_set(level_of(F.col(lat), F.col(radius_km))).alias("levels")).scalar()


def radius_filter(places: DataFrame, lat: float, lng: float, radius_km: float, lat_col="lat", lng_col="lng") -> DataFrame:
    """Places inside one circle.  The literal box bounds reach the file scan."""
    import math

    angle = math.degrees(radius_km / fixed.EARTH_RADIUS_KM) + _SLACK
    places = places.filter(F.col(lat_col).between(lat - angle, lat + angle))
    inside = within(F.lit(lat), F.lit(lng), F.lit(radius_km), F.col(lat_col), F.col(lng_col))
    return places.filter(inside)


def geo_join(requests: DataFrame, places: DataFrame, lat="lat", lng="lng", place_lat="place_lat", place_lng="place_lng"):
    """Every (request, place) pair no farther apart than ``radius_km``, with ``km``.

    Equi-join on grid cells; a place lies in one cell of a level and a request
    lists each cell of its one level once, so no pair appears twice.
    """
    asked = requests.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col("radius_km").isNotNull())
    left = asked.withColumn("_cell", F.explode(cells_around(F.col(lat), F.col(lng), F.col("radius_km"))))
    placed = places.filter(F.col(place_lat).isNotNull() & F.col(place_lng).isNotNull()).withColumn("_levels", levels_in(asked, lat))
    right = placed.withColumn("_cell", F.explode(cells_of(F.col(place_lat), F.col(place_lng), F.col("_levels")))).drop("_levels")
    near = within(F.col(lat), F.col(lng), F.col("radius_km"), F.col(place_lat), F.col(place_lng))
    return (
        left.join(right, "_cell")
        .filter(near)
        .withColumn("km", haversine_km(F.col(lat), F.col(lng), F.col(place_lat), F.col(place_lng)))
        .drop("_cell")
    )
