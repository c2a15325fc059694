"""Heap metrics over labelled or polygon-covered cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundlake.functions import cells as cx
from moundlake.operators import neighbourhood as nb
from moundlake.operators.quantiles import MICRON, exact_mean
from moundlake.runtime import bounded_broadcast


def shift_base(height: DataFrame, shifts: DataFrame) -> DataFrame:
    """Heights after a base change: nodata is zero first, then minus delta, negatives to zero."""
    moved = height.join(bounded_broadcast(shifts.select("survey_id", "delta")), "survey_id", "left")
    zeroed = cx.finite_or_zero(F.col("v"))
    delta = F.coalesce("delta", F.lit(0.0))
    value = F.when(F.abs(delta) > 1e-6, F.round(zeroed - delta, MICRON)).otherwise(zeroed)
    return moved.select("survey_id", "r", "c", F.greatest(value, F.lit(0.0)).alias("v"))


def with_gradient(height: DataFrame, grids: DataFrame) -> DataFrame:
    """Dense heights (nodata zero) with world position and the cell's 3-D surface element."""
    geometry = bounded_broadcast(grids.select("survey_id", "west", "north", "res"))
    cleaned = height.select("survey_id", "r", "c", cx.finite_or_zero(F.col("v")).alias("v")).join(geometry, "survey_id")
    res = F.col("res")
    sloped = nb.gradient(cleaned, "v", res)
    return sloped.withColumn(
        "surface", res * res * F.sqrt(F.lit(1.0) + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    )


def heap_metrics(
    zones: DataFrame,
    sloped: DataFrame,
    threshold: Column | float = 0.5,
    keys: tuple[str, ...] = ("survey_id", "heap_id"),
    empty_centroid: str = "zero",
) -> DataFrame:
    """All metrics of every zone in one aggregation over ``zones`` joined with cells.

    Every aggregate is algebraic, so a heap spanning many partitions is combined
    map-side. ``empty_centroid`` is the value used when no cell is above the
    threshold: ``zero`` for labelled heaps, ``mean`` of the cells for polygons.
    """
    above = F.col("v") > threshold
    weight = F.when(above, F.col("v")).otherwise(F.lit(0.0))
    res = F.col("res")
    east = cx.centre_east(F.col("c"), F.col("west"), res) - F.col("west")
    north = F.col("north") - cx.centre_north(F.col("r"), F.col("north"), res)
    agg = zones.join(sloped, ["survey_id", "r", "c"]).groupBy(*keys).agg(
        F.sum(weight).alias("_w"),
        F.count_if(above).alias("_n"),
        exact_mean(F.col("v"), above).alias("_mean"),
        F.max("v").alias("max_height_m"),
        F.sum(F.when(above, F.col("surface")).otherwise(F.lit(0.0))).alias("surface_area_m2"),
        # offsets from the grid corner keep the weighted sums small and exact
        F.sum(weight * east).alias("_we"),
        F.sum(weight * north).alias("_wn"),
        F.avg(east).alias("_me"),
        F.avg(north).alias("_mn"),
        F.min("r").alias("_r1"), F.max("r").alias("_r2"), F.min("c").alias("_c1"), F.max("c").alias("_c2"),
        F.max("res").alias("res"), F.max("west").alias("west"), F.max("north").alias("north"),
    )
    n, w = F.col("_n"), F.col("_w")

    def centroid(total: Column, mean: Column, place) -> Column:
        fallback = place(mean) if empty_centroid == "mean" else F.lit(0.0)
        return F.when(w > 0, place(total / w)).otherwise(fallback)

    return agg.select(
        *keys,
        (w * res * res).alias("volume_m3"),
        (n * res * res).alias("planimetric_area_m2"),
        "surface_area_m2",
        "max_height_m",
        F.col("_mean").alias("mean_height_m"),
        centroid(F.col("_we"), F.col("_me"), lambda v: F.col("west") + v).alias("centroid_e"),
        centroid(F.col("_wn"), F.col("_mn"), lambda v: F.col("north") - v).alias("centroid_n"),
        (F.col("west") + F.col("_c1") * res).alias("bbox_min_e"),
        (F.col("north") - (F.col("_r2") + 1) * res).alias("bbox_min_n"),
        (F.col("west") + (F.col("_c2") + 1) * res).alias("bbox_max_e"),
        (F.col("north") - F.col("_r1") * res).alias("bbox_max_n"),
    )


def base_provenance(surveys: DataFrame, heaps: DataFrame, use_survey_value: bool = True) -> DataFrame:
    """Base elevation in force: the survey's, else that of its first heap, else 0."""
    first = heaps.groupBy("survey_id").agg(F.min_by("base_elevation", "heap_id").alias("_heap_base"))
    own = F.col("base_elevation") if use_survey_value else F.lit(None).cast("double")
    return surveys.join(first, "survey_id", "left").select(
        "survey_id", F.coalesce(own, F.col("_heap_base"), F.lit(0.0)).alias("base")
    )


def volume_shift_preview(heaps: DataFrame, delta: Column) -> DataFrame:
    """Fast preview of a base change: minus delta times the area of the heaps in use."""
    return heaps.where("not is_excluded").groupBy("survey_id").agg(
        F.sum("planimetric_area_m2").alias("area_m2")
    ).select("survey_id", "area_m2", (-delta * F.col("area_m2")).alias("delta_volume_m3"))
