"""Polygons against rasters: rasterise, sample, re-measure, crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundlake.functions.rings import polygon_bounds
from moundlake.operators import zonal
from moundlake.runtime import bounded_broadcast


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """One row per ring edge: (survey_id, poly_id, ring, i, x1, y1, x2, y2); rings close themselves."""
    rings = polygons.select("survey_id", "poly_id", F.posexplode("rings").alias("ring", "pts"))
    closed = F.when(
        (F.element_at("pts", 1)[0] == F.element_at("pts", -1)[0])
        & (F.element_at("pts", 1)[1] == F.element_at("pts", -1)[1]),
        F.col("pts"),
    ).otherwise(F.concat(F.col("pts"), F.array(F.element_at("pts", 1))))
    pairs = F.zip_with(
        F.slice("pts", F.lit(1), F.size("pts") - 1),
        F.slice("pts", F.lit(2), F.size("pts") - 1),
        lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
    )
    return (
        rings.where(F.size("pts") >= 2)
        .withColumn("pts", closed)
        .select("survey_id", "poly_id", "ring", F.posexplode(pairs).alias("i", "e"))
        .select("survey_id", "poly_id", "ring", "i", "e.x1", "e.y1", "e.x2", "e.y2")
    )


def rasterise(polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells whose centre lies in the polygon (even-odd): (survey_id, poly_id, r, c).

    Scanline: every edge is spread over the cell rows it spans (half-open in y),
    crossings of one polygon row are paired in x order, and each pair gives a
    span of columns (half-open in x). No test of cells against polygons.
    """
    geometry = bounded_broadcast(grids.select("survey_id", "west", "north", "res", "width", "height"))
    edges = polygon_edges(polygons).join(geometry, "survey_id").where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    north, res = F.col("north"), F.col("res")
    # rows whose centre y = north - (r + 0.5) res satisfies low <= y < high, with slack; checked below
    first = F.greatest(F.lit(0), F.floor((north - high) / res - 0.5).cast("int"))
    last = F.least(F.col("height") - 1, F.ceil((north - low) / res - 0.5).cast("int"))
    crossings = (
        edges.withColumn("_a", first)
        .withColumn("_b", last)
        .where("_a <= _b")
        .withColumn("r", F.explode(F.sequence("_a", "_b")))
        .withColumn("y", north - (F.col("r") + F.lit(0.5)) * res)
        .where((F.col("y") >= low) & (F.col("y") < high))
        .withColumn("x", F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    line = Window.partitionBy("survey_id", "poly_id", "r").orderBy("x", "ring", "i")
    spans = (
        crossings.withColumn("_k", F.row_number().over(line))
        .withColumn("x_end", F.lead("x").over(line))
        .where("_k % 2 = 1 and x_end is not null")
    )
    start = F.greatest(F.lit(0), F.ceil((F.col("x") - F.col("west")) / res - 0.5).cast("int"))
    stop = F.least(F.col("width"), F.ceil((F.col("x_end") - F.col("west")) / res - 0.5).cast("int"))
    return (
        spans.withColumn("_c1", start)
        .withColumn("_c2", stop)
        .where("_c1 < _c2")
        .select("survey_id", "poly_id", "r", F.explode(F.sequence(F.col("_c1"), F.col("_c2") - 1)).alias("c"))
    )


def ground_samples(surface: DataFrame, polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """Mean, population deviation and count per polygon and pooled (poly_id NULL).

    Polygons without a cell keep a row with count 0; a survey where no polygon
    holds a cell is marked by ``pooled_error``.
    """
    inside = rasterise(polygons, grids).join(surface.where("v is not null"), ["survey_id", "r", "c"])
    stats = [
        F.avg("v").alias("mean_elevation"),
        F.stddev_pop("v").alias("std_elevation"),
        F.count("v").alias("num_pixels"),
    ]
    measured = (
        inside.groupingSets([["survey_id", "poly_id"], ["survey_id"]], "survey_id", "poly_id")
        .agg(F.grouping("poly_id").alias("_all"), *stats)
    )
    each = polygons.select("survey_id", "poly_id").join(
        measured.where("_all = 0").drop("_all"), ["survey_id", "poly_id"], "left"
    )
    pooled = (
        polygons.select("survey_id").distinct()
        .join(measured.where("_all = 1").drop("_all", "poly_id"), "survey_id", "left")
        .withColumn("poly_id", F.lit(None).cast(polygons.schema["poly_id"].dataType))
    )
    return (
        each.unionByName(pooled)
        .withColumn("num_pixels", F.coalesce("num_pixels", F.lit(0).cast("bigint")))
        .withColumn("pooled_error", F.col("poly_id").isNull() & (F.col("num_pixels") == 0))
    )


def polygon_metrics(
    height: DataFrame,
    polygons: DataFrame,
    grids: DataFrame,
    threshold: float = 0.5,
    shifts: DataFrame | None = None,
    keep_failures: bool = True,
) -> DataFrame:
    """Metrics per polygon; overlapping polygons each get their own cells.

    With ``keep_failures`` a polygon that covers no cell gives a row with ``error``
    (single recompute); without it the polygon is skipped (batch recompute).
    """
    if shifts is not None:
        height = zonal.shift_base(height, shifts)
    sloped = zonal.with_gradient(height, grids)
    zones = rasterise(polygons, grids)
    measured = zonal.heap_metrics(zones, sloped, threshold, ("survey_id", "poly_id"), empty_centroid="mean")
    bounds = polygons.select("survey_id", "poly_id", polygon_bounds(F.col("rings")).alias("b"))
    joined = bounds.join(
        measured.drop("bbox_min_e", "bbox_min_n", "bbox_max_e", "bbox_max_n"),
        ["survey_id", "poly_id"],
        "left" if keep_failures else "inner",
    )
    return joined.select(
        "*",
        F.col("b.min_x").alias("bbox_min_e"), F.col("b.min_y").alias("bbox_min_n"),
        F.col("b.max_x").alias("bbox_max_e"), F.col("b.max_y").alias("bbox_max_n"),
        F.when(F.col("volume_m3").isNull(), F.lit("polygon does not intersect the raster")).alias("error"),
    ).drop("b")


def crop_windows(polygons: DataFrame, grids: DataFrame, padding_percent: float = 20.0) -> DataFrame:
    """Cell window around each polygon's bounds, padded in percent and clamped to the raster."""
    geometry = bounded_broadcast(grids.select("survey_id", "west", "north", "res", "width", "height"))
    b = polygons.select("survey_id", "poly_id", polygon_bounds(F.col("rings")).alias("b")).join(geometry, "survey_id")
    pad_x = (F.col("b.max_x") - F.col("b.min_x")) * F.lit(padding_percent) / 100.0
    pad_y = (F.col("b.max_y") - F.col("b.min_y")) * F.lit(padding_percent) / 100.0

    def clamp(index, size):
        return F.greatest(F.lit(0), F.least(F.floor(index).cast("int"), F.col(size) - 1))

    return b.select(
        "survey_id", "poly_id",
        clamp((F.col("north") - (F.col("b.max_y") + pad_y)) / F.col("res"), "height").alias("row_start"),
        clamp((F.col("north") - (F.col("b.min_y") - pad_y)) / F.col("res"), "height").alias("row_end"),
        clamp(((F.col("b.min_x") - pad_x) - F.col("west")) / F.col("res"), "width").alias("col_start"),
        clamp(((F.col("b.max_x") + pad_x) - F.col("west")) / F.col("res"), "width").alias("col_end"),
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, block: float = 16.0) -> DataFrame:
    """Exact point membership: (point columns, poly_id), by crossings to the left of each point.

    Edges are spread over square blocks: their own rows of blocks, from their left
    end to the right end of their polygon. A point meets the edges of its block as one
    array, as long as the outlines in 16 m are, and the parity of its crossings per polygon decides
    within the row; so points are shuffled once and need no identifiers.
    """
    right = polygons.select("survey_id", "poly_id", polygon_bounds(F.col("rings"))["max_x"].alias("_right"))
    edges = polygon_edges(polygons).where("y1 <> y2").join(right, ["survey_id", "poly_id"])
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))
    spread = edges.withColumn("_by", blocks(F.least("y1", "y2"), F.greatest("y1", "y2"))).withColumn(
        "_bx", blocks(F.least("x1", "x2"), F.col("_right"))
    )
    by_block = spread.groupBy("survey_id", "_bx", "_by").agg(
        F.collect_list(F.struct("poly_id", "x1", "y1", "x2", "y2")).alias("_edges")
    )
    placed = points.select(
        "survey_id", F.struct(*points.columns).alias("_point"), "x", "y",
        F.floor(F.col("x") / block).alias("_bx"), F.floor(F.col("y") / block).alias("_by"),
    )

    def crossed(e: Column) -> Column:
        at = e.x1 + (F.col("y") - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
        return ((e.y1 <= F.col("y")) != (e.y2 <= F.col("y"))) & (at <= F.col("x"))

    hits = placed.join(by_block, ["survey_id", "_bx", "_by"]).select(
        "_point", F.transform(F.filter("_edges", crossed), lambda e: e.poly_id).alias("_hits")
    )
    odd = F.filter(F.array_distinct("_hits"), lambda p: F.size(F.filter("_hits", lambda h: h == p)) % 2 == 1)
    return hits.select("_point", F.explode(odd).alias("poly_id")).select("_point.*", "poly_id")


def points_in_heaps(binned_points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with the heap of their cell; NULL on background."""
    return binned_points.join(labels, ["survey_id", "r", "c"], "left")
