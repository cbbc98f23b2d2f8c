"""Coordinates: bounds, bearings, GeoJSON, and attributes of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(points: Column) -> Column:
    """(west, south, east, north) of an array of [x, y]; null if empty."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))
    return F.when(F.size(points) > 0, box)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees from north, east positive, on a plane at the mean latitude."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.degrees(F.atan2(east, lat2 - lat1))


def edge_attributes(steps: DataFrame, a: str, b: str, attributes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``steps`` with the attributes of their edge, whichever way it was stored."""
    lo, hi = F.least(src, dst).alias("_lo"), F.greatest(src, dst).alias("_hi")
    rest = [c for c in attributes.columns if c not in (src, dst)]
    known = attributes.select(lo, hi, *rest)
    keyed = steps.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    return keyed.join(known, ["_lo", "_hi"], "left").drop("_lo", "_hi")


def feature(ring: Column, **properties: Column) -> Column:
    """A GeoJSON polygon feature of one ring, as compact text."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in sorted(properties.items())]).alias("properties")))


def feature_ring(text: Column) -> Column:
    """The outer ring of a GeoJSON polygon feature; null if it is none."""
    f = F.from_json(text, "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>")
    return F.when((f["type"] == "Feature") & (f["geometry"]["type"] == "Polygon"), F.get(f["geometry"]["coordinates"], F.lit(0)))
