"""Expressions over polygon rings (arrays of [x, y] points, even-odd rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundlake.schema import RINGS


def ring_area(ring: Column) -> Column:
    """Shoelace area of one ring, unsigned; coordinates are taken relative to the first vertex."""
    x0, y0 = ring[0][0], ring[0][1]
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: (p[0] - x0) * (q[1] - y0) - (q[0] - x0) * (p[1] - y0),
    )
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)) / F.lit(2.0)


def polygon_area(rings: Column) -> Column:
    """First ring minus its holes."""
    areas = F.transform(rings, ring_area)
    return F.aggregate(areas, F.lit(0.0), lambda acc, v: acc - v) + F.lit(2.0) * areas[0]


def oriented_area(rings: Column) -> Column:
    """Area of rings whose holes run clockwise (as the geometry helpers write them), any number of parts."""
    origin_x, origin_y = rings[0][0][0], rings[0][0][1]

    def signed(ring: Column) -> Column:
        terms = F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1),
            F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda p, q: (p[0] - origin_x) * (q[1] - origin_y) - (q[0] - origin_x) * (p[1] - origin_y),
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda acc, v: acc + v) / F.lit(2.0)


def ring_length(ring: Column) -> Column:
    steps = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def polygon_bounds(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def parse_geometry(text: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon text to an array of parts, each an array of rings.

    NULL for other types and for text that does not parse.
    """
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    single = F.from_json(coordinates, RINGS)
    many = F.from_json(coordinates, T.ArrayType(RINGS))
    return F.when(kind == "Polygon", F.when(single.isNotNull(), F.array(single))).when(
        kind == "MultiPolygon", many
    )


def largest_part(parts: Column) -> Column:
    """Part of greatest area; the first one wins ties."""
    ranked = F.transform(parts, lambda part, i: F.struct(polygon_area(part).alias("a"), (-i).alias("i"), part.alias("p")))
    return F.array_max(ranked)["p"]


def to_geojson(rings: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
