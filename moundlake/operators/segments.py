"""Heaps as connected components of the height mask, and their classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundlake.operators import neighbourhood as nb
from moundlake.operators.graph import connected_components
from moundlake.operators.quantiles import exact_mean
from moundlake.runtime import bounded_broadcast, cut_lineage

BAND_CELLS = 2_000_000   # cells of one row band handed to one task
COLUMN_BLOCK = 64        # runs meet in column blocks of this width

# Limits of the classification rules.
MACHINERY_COMPACTNESS = 0.85
MACHINERY_AREA = 500.0
MACHINERY_STD = 1.0
STRUCTURE_STD = 0.2
STRUCTURE_MEAN = 2.0


def heap_mask(height: DataFrame, threshold: float = 0.5, open_k: int = 3, close_k: int = 7) -> DataFrame:
    """Cells of the cleaned mask: strictly above the threshold, opened, closed."""
    flagged = height.withColumn("m", (F.coalesce("v", F.lit(0.0)) > F.lit(threshold)).cast("int"))
    cleaned = nb.binary_closing(nb.binary_opening(flagged, "m", open_k), "m", close_k)
    return cleaned.where("m = 1").select("survey_id", "r", "c")


def mask_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs (survey_id, r, c1, c2): gaps and islands per grid line."""
    island = F.col("c") - F.row_number().over(nb.row_line())
    return (
        mask.withColumn("_island", island)
        .groupBy("survey_id", "r", "_island")
        .agg(F.min("c").alias("c1"), F.max("c").alias("c2"))
        .drop("_island")
    )


def _band_roots(r: np.ndarray, c1: np.ndarray, c2: np.ndarray, width: int) -> np.ndarray:
    """Least linear cell index of each run's 8-connected component; runs sorted by (r, c1)."""
    n = len(r)
    wide = np.int64(width + 3)
    starts = r.astype(np.int64) * wide + c1
    ends = r.astype(np.int64) * wide + c2
    # runs of the next line whose span, widened by one cell, meets this run
    lo = np.searchsorted(ends, starts + wide - 1, side="left")
    hi = np.searchsorted(starts, ends + wide + 1, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            break
        root = nxt
    while not np.array_equal(root[root], root):
        root = root[root]
    index = r.astype(np.int64) * width + c1
    least = index.copy()
    np.minimum.at(least, root, index)
    return least[root]


def _label_band(keys: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    runs = runs.sort_values(["r", "c1"])
    node = _band_roots(runs["r"].to_numpy(), runs["c1"].to_numpy(), runs["c2"].to_numpy(), int(runs["width"].iloc[0]))
    return runs[["survey_id", "r", "c1", "c2"]].assign(node=node)


def label_runs(mask: DataFrame, grids: DataFrame) -> DataFrame:
    """Runs with the root of their component: (survey_id, r, c1, c2, root).

    A grid is cut into row bands of at most ``BAND_CELLS`` cells. Each band is
    labelled inside one task; components that touch across a band edge meet as
    edges of a small graph, solved by the distributed loop. Grids of one band
    have no such edges and skip the loop.
    """
    geometry = bounded_broadcast(grids.select("survey_id", "width"))
    band_rows = F.greatest(F.lit(1), F.floor(F.lit(BAND_CELLS) / F.col("width"))).cast("int")
    runs = mask_runs(mask).join(geometry, "survey_id").withColumn("band", F.floor(F.col("r") / band_rows).cast("int"))
    labelled = cut_lineage(
        runs.groupBy("survey_id", "band").applyInPandas(
            _label_band, "survey_id long, r int, c1 int, c2 int, node long"
        )
    )
    seams = labelled.join(geometry, "survey_id").withColumn("_rows", band_rows)
    blocks = lambda lo, hi: F.explode(
        F.sequence(F.floor(lo / COLUMN_BLOCK).cast("int"), F.floor(hi / COLUMN_BLOCK).cast("int"))
    )
    upper = seams.where("(r + 1) % _rows = 0").select(
        "survey_id", (F.col("r") + 1).alias("r"), F.col("c1").alias("a1"), F.col("c2").alias("a2"),
        F.col("node").alias("a"), blocks(F.col("c1") - 1, F.col("c2") + 1).alias("block"),
    )
    lower = seams.where("r % _rows = 0").select(
        "survey_id", "r", "c1", "c2", F.col("node").alias("b"), blocks(F.col("c1"), F.col("c2")).alias("block"),
    )
    edges = (
        upper.join(lower, ["survey_id", "r", "block"])
        .where("c1 <= a2 + 1 and c2 >= a1 - 1")
        .select("survey_id", "a", "b")
        .distinct()
    )
    if edges.isEmpty():
        return labelled.withColumnRenamed("node", "root")
    roots = connected_components(edges)
    return labelled.join(roots, ["survey_id", "node"], "left").select(
        "survey_id", "r", "c1", "c2", F.coalesce("root", "node").alias("root")
    )


def rank_roots(roots: DataFrame, width: DataFrame) -> DataFrame:
    """Dense heap numbers in the order of the root cell, without one task per survey.

    Roots are counted per grid line, the line totals are accumulated (as many rows
    as the grid is high), and the number inside the line is added.
    """
    placed = roots.join(bounded_broadcast(width.select("survey_id", "width")), "survey_id").withColumn(
        "_line", F.floor(F.col("root") / F.col("width"))
    )
    totals = placed.groupBy("survey_id", "_line").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("survey_id").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("survey_id", "_line", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("survey_id", "_line").orderBy("root"))
    return (
        placed.withColumn("_k", inside)
        .join(offsets, ["survey_id", "_line"])
        .select("survey_id", "root", (F.col("_offset") + F.col("_k")).cast("long").alias("heap_id"))
    )


def label_cells(mask: DataFrame, grids: DataFrame) -> DataFrame:
    """8-connected components: (survey_id, r, c, heap_id), numbered by their first cell."""
    runs = label_runs(mask, grids)
    ids = rank_roots(runs.select("survey_id", "root").distinct(), grids)
    return (
        runs.join(ids, ["survey_id", "root"])
        .select("survey_id", "r", F.explode(F.sequence("c1", "c2")).alias("c"), "heap_id")
    )


def component_statistics(labels: DataFrame, height: DataFrame, grids: DataFrame) -> DataFrame:
    """Area, mean, population deviation, maximum (unthresholded), boundary length and compactness per heap."""
    flagged = nb.boundary_flag(labels, "heap_id")
    joined = flagged.join(height, ["survey_id", "r", "c"]).withColumn("h", F.coalesce("v", F.lit(0.0)))
    stats = joined.groupBy("survey_id", "heap_id").agg(
        F.count(F.lit(1)).alias("cells"),
        exact_mean(F.col("h"), F.lit(True)).alias("height_mean"),
        F.stddev_pop("h").alias("height_std"),
        F.max("h").alias("height_max"),
        F.count_if("is_boundary").alias("boundary_cells"),
    )
    res = F.col("res")
    perimeter = F.col("boundary_cells") * res
    area = F.col("cells") * res * res
    compactness = F.when(
        perimeter > 0, F.least(F.lit(1.0), F.lit(4.0) * F.pi() * area / (perimeter * perimeter))
    ).otherwise(F.lit(0.0))
    return stats.join(bounded_broadcast(grids.select("survey_id", "res")), "survey_id").select(
        "survey_id", "heap_id", "cells", area.alias("area_m2"), compactness.alias("compactness"),
        "height_mean", "height_std", "height_max", "boundary_cells",
    )


def filter_code(area: Column, compactness: Column, std: Column, mean: Column, min_area: Column) -> Column:
    """First rule that holds: too_small, machinery, structure; NULL for an accepted heap."""
    return (
        F.when(area < min_area, F.lit("too_small"))
        .when(
            (compactness > MACHINERY_COMPACTNESS) & (area < MACHINERY_AREA) & (std < MACHINERY_STD),
            F.lit("machinery"),
        )
        .when((std < STRUCTURE_STD) & (mean > STRUCTURE_MEAN), F.lit("structure"))
    )


def classify(stats: DataFrame, min_area: Column | float = 50.0, max_area: Column | float = 50000.0) -> DataFrame:
    """Adds filter_code, is_filtered, filter_reason and needs_review; limits are numbers or columns of ``stats``."""
    area, compact, std, mean = (F.col(n) for n in ("area_m2", "compactness", "height_std", "height_mean"))
    code = filter_code(area, compact, std, mean, F.lit(min_area))
    reason = (
        F.when(code == "too_small", F.format_string("Area too small (%.1f < %.0f m2)", area, F.lit(min_area)))
        .when(
            code == "machinery",
            F.format_string(
                "High compactness (%.2f), small area (%.1f m2), uniform height (std=%.2f m): probably machinery",
                compact, area, std,
            ),
        )
        .when(
            code == "structure",
            F.format_string("Uniform height (std=%.2f m, mean=%.2f m): probably a structure", std, mean),
        )
    )
    return (
        stats.withColumn("filter_code", code)
        .withColumn("is_filtered", code.isNotNull())
        .withColumn("filter_reason", reason)
        .withColumn("needs_review", area > max_area)
    )


def split_accepted(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted heaps, and filtered heaps with their warning text."""
    accepted = classified.where("not is_filtered")
    filtered = classified.where("is_filtered").withColumn(
        "warning", F.format_string("Heap %d filtered: %s", "heap_id", "filter_reason")
    )
    return accepted, filtered


def component_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if(~F.col("is_filtered")).alias("accepted"),
        F.count_if("is_filtered").alias("filtered"),
    )
