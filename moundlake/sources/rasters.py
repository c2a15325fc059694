"""Raster tables: metadata, windows, tiles and regions as predicates on the cell key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.runtime import bounded_broadcast


def raster_metadata(grids: DataFrame) -> DataFrame:
    """Bounds, size and resolution of each raster."""
    return grids.select(
        "survey_id", "width", "height", "res", "crs",
        F.col("west").alias("min_x"), (F.col("north") - F.col("height") * F.col("res")).alias("min_y"),
        (F.col("west") + F.col("width") * F.col("res")).alias("max_x"), F.col("north").alias("max_y"),
    )


def window(cells: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    return cells.where(
        (F.col("r") >= row) & (F.col("r") < row + height) & (F.col("c") >= col) & (F.col("c") < col + width)
    )


def with_tiles(cells: DataFrame, tile: int = 1024) -> DataFrame:
    """Tile key of every cell; the last tile of a line is ragged."""
    return cells.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int")).withColumn(
        "tile_c", F.floor(F.col("c") / tile).cast("int")
    )


def region(cells: DataFrame, grids: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Cells of a world rectangle, cut to the raster's extent."""
    g = grids.select(
        "survey_id",
        F.greatest(F.lit(0), F.floor((min_x - F.col("west")) / F.col("res")).cast("int")).alias("ca"),
        F.least(F.col("width"), F.ceil((max_x - F.col("west")) / F.col("res")).cast("int")).alias("cb"),
        F.greatest(F.lit(0), F.floor((F.col("north") - max_y) / F.col("res")).cast("int")).alias("ra"),
        F.least(F.col("height"), F.ceil((F.col("north") - min_y) / F.col("res")).cast("int")).alias("rb"),
    )
    return cells.join(bounded_broadcast(g), "survey_id").where("r >= ra and r < rb and c >= ca and c < cb").drop(
        "ca", "cb", "ra", "rb"
    )


def with_imported(computed: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported surfaces replace the computed ones of the same survey."""
    ready = bounded_broadcast(imported.select("survey_id").distinct())
    return computed.join(ready, "survey_id", "left_anti").unionByName(imported)
