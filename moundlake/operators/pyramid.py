"""Tile pyramids and display stretches of rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundlake.runtime import bounded_broadcast, broadcast_aggregate, cut_lineage

TILE = 256


def pyramid_levels(grids: DataFrame, tile: int = TILE, min_zoom: int = 0) -> DataFrame:
    """One row per survey and zoom: resolution and square tile extent."""
    size = F.greatest("width", "height").cast("double")
    max_zoom = F.greatest(F.lit(0), F.ceil(F.log2(size / tile)).cast("int"))
    extent = size * F.col("res")
    return grids.select("*", max_zoom.alias("max_zoom"), extent.alias("extent")).select(
        "*", F.explode(F.sequence(F.lit(min_zoom), F.greatest(F.lit(min_zoom), F.col("max_zoom")))).alias("z")
    ).withColumn("tile_resolution", F.col("extent") / (F.lit(tile) * F.pow(F.lit(2.0), F.col("z")))).withColumn(
        "tile_extent", F.col("extent") / F.pow(F.lit(2.0), F.col("z"))
    )


def finest_pixels(cells: DataFrame, grids: DataFrame, bands: tuple[str, ...], tile: int, min_zoom: int) -> DataFrame:
    """Pixel states ``(survey_id, z, max_zoom, gx, gy, <band>_n, _sum, _lo, _hi)`` of the levels that need the cells themselves.

    At the finest zoom (and any beyond) a pixel is no larger than a cell, so a cell fills all pixels whose centre it covers. At the zoom
    before that every cell centre falls into one pixel.
    """
    levels = bounded_broadcast(pyramid_levels(grids, tile, min_zoom).where("z >= max_zoom - 1"))
    placed = cells.where(" or ".join(f"`{b}` is not null" for b in bands)).join(levels, "survey_id")
    scale = F.col("res") / F.col("tile_resolution")

    def span(index: str) -> Column:
        """Pixels whose centre lies in the cell, or the pixel under the cell centre."""
        low, high = F.col(index) * scale, (F.col(index) + 1) * scale
        first, last = F.ceil(low - 0.5).cast("int"), F.ceil(high - 0.5).cast("int") - 1
        centre = F.floor((F.col(index) + 0.5) * scale).cast("int")
        return F.when(scale >= 1.0, F.sequence(first, F.greatest(first, last))).otherwise(F.array(centre))

    pixels = placed.withColumn("gy", F.explode(span("r"))).withColumn("gx", F.explode(span("c")))
    state = []
    for b in bands:
        state += [
            F.count(b).alias(f"{b}_n"), F.sum(F.round(F.col(b) * 1e6).cast("long")).alias(f"{b}_sum"), F.min(b).alias(f"{b}_lo"), F.max(b).alias(f"{b}_hi"),
        ]
    return pixels.groupBy("survey_id", "z", "max_zoom", "gx", "gy").agg(*state)


def coarser(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """The level below: four pixels become one, their states merged."""
    half = lambda g: F.shiftright(g, 1).alias(g)
    state = []
    for b in bands:
        state += [F.sum(f"{b}_n").alias(f"{b}_n"), F.sum(f"{b}_sum").alias(f"{b}_sum"), F.min(f"{b}_lo").alias(f"{b}_lo"), F.max(f"{b}_hi").alias(f"{b}_hi")]
    return pixels.groupBy("survey_id", (F.col("z") - 1).alias("z"), "max_zoom", half("gx"), half("gy")).agg(*state)


def pyramid_states(cells: DataFrame, grids: DataFrame, bands: tuple[str, ...] = ("v",), tile: int = TILE, min_zoom: int = 0) -> DataFrame:
    """Pixel states of every survey and zoom, level by level: each is rolled up from the one above it and reads nothing else.

    A level is a quarter of the one above, so all of them together cost a third of the finest.
    """
    base = cut_lineage(finest_pixels(cells, grids, bands, tile, min_zoom))
    top = pyramid_levels(grids, tile, min_zoom).agg(F.max("max_zoom")).first()[0]
    out, above = base, None
    for z in range((top or 0) - 2, min_zoom - 1, -1):
        entering = base.where((F.col("z") == z + 1) & (F.col("max_zoom") == z + 2))
        above = cut_lineage(coarser(entering if above is None else above.unionByName(entering), bands))
        out = out.unionByName(above)
    return out


def pyramid_tiles(cells: DataFrame, grids: DataFrame, tile: int = TILE, min_zoom: int = 0, bands: tuple[str, ...] = ("v",)) -> DataFrame:
    """Mean of the cells under every tile pixel: (survey_id, z, tx, ty, px, py, a column per band).

    Means are whole micrometres (millionths for other bands), rounded half up, from exact sums. Pixels outside the raster are
    absent (transparent); a band without a value under a pixel is NULL there.
    """
    states = pyramid_states(cells, grids, bands, tile, min_zoom)

    def mean(b: str) -> Column:
        n, twice = F.col(f"{b}_n"), F.col(f"{b}_sum") * 2 + F.col(f"{b}_n")
        return F.when(n > 0, (twice - F.pmod(twice, n * 2)) / (n * 2) / 1e6).alias(b)

    return states.select(
        "survey_id", "z", F.floor(F.col("gx") / tile).cast("int").alias("tx"), F.floor(F.col("gy") / tile).cast("int").alias("ty"),
        F.pmod("gx", F.lit(tile)).alias("px"), F.pmod("gy", F.lit(tile)).alias("py"), *map(mean, bands),
    )


def stretch_tiles(tiles: DataFrame, bands: tuple[str, ...] = ("v",)) -> DataFrame:
    """Min-max stretch of every band to 0-255 per tile; a flat tile becomes 0. Adds ``level`` (``<band>_level`` for several bands).

    A window partition is one tile, so one shuffle serves the ranges and the pixels.
    """
    whole = Window.partitionBy("survey_id", "z", "tx", "ty")

    def level(b: str) -> Column:
        lo, hi = F.min(b).over(whole), F.max(b).over(whole)
        value = F.when(hi > lo, F.floor((F.col(b) - lo) / (hi - lo) * 255)).otherwise(F.lit(0))
        return F.when(F.col(b).isNotNull(), value.cast("int"))

    return tiles.withColumns({"level" if len(bands) == 1 else f"{b}_level": level(b) for b in bands})


def height_map(height: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Normalised height per cell and opacity; cells below the threshold are transparent (``>=``)."""
    value = F.coalesce("v", F.lit(0.0))
    peaks = height.where(value >= threshold).groupBy("survey_id").agg(F.max("v").alias("_top"))
    top = F.when(F.col("_top") > threshold, F.col("_top")).otherwise(F.lit(threshold + 1.0))
    return height.join(broadcast_aggregate(peaks), "survey_id", "left").select(
        "survey_id", "r", "c",
        F.when(
            F.col("_top").isNotNull(),
            F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - threshold) / (top - threshold))), 6),
        ).otherwise(F.lit(0.0)).alias("t"),
        F.when(value >= threshold, F.lit(255)).otherwise(F.lit(0)).alias("alpha"),
    )


def elevation_ramp(points: DataFrame, bases: DataFrame) -> DataFrame:
    """Ramp coordinate of each point: from the survey's base (else its lowest point) to its highest."""
    ranges = points.groupBy("survey_id").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    known = ranges.join(bases, "survey_id", "left").withColumn("_lo", F.coalesce("base", "_lo")).drop("base")
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.01))
    return points.join(broadcast_aggregate(known), "survey_id").withColumn(
        "t", (F.col("z") - F.col("_lo")) / span
    ).drop("_lo", "_hi")
