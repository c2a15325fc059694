"""Heaps of height rasters in one exchange: tiles with a halo.

Every cell goes to its tile and to the tiles within reach of the opening and the closing.
Threshold, opening, closing and labels then run inside a tile, and its runs carry all that the statistics
add up. Components that touch across tile edges are edges of a small graph, solved by the
distributed loop.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moundlake.operators.graph import connected_components
from moundlake.operators.segments import COLUMN_BLOCK, _band_roots, rank_roots
from moundlake.runtime import bounded_broadcast, cut_lineage

TILE = 512  # cells along a side: a task holds one tile and its halo
RUNS = (
    "survey_id long, tr int, tc int, r int, c1 int, c2 int, node long, boundary_cells long, micro long, squares decimal(20,0), top double"
)


def box_count(mask: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Set cells within ``reach`` along an axis; outside of the array counts as not set."""
    sides = [(0, 0), (0, 0)]
    sides[axis] = (reach + 1, reach)
    sums = np.cumsum(np.pad(mask, sides), axis=axis, dtype=np.int32)
    n = mask.shape[axis]
    return np.take(sums, np.arange(2 * reach + 1, 2 * reach + 1 + n), axis) - np.take(sums, np.arange(n), axis)


def erode(mask: np.ndarray, k: int) -> np.ndarray:
    reach = k // 2
    rows = box_count(mask, reach, 1) == 2 * reach + 1
    return box_count(rows, reach, 0) == 2 * reach + 1


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    return box_count(box_count(mask, k // 2, 1) > 0, k // 2, 0) > 0


def clean_mask(flagged: np.ndarray, inside: np.ndarray, open_k: int, close_k: int) -> np.ndarray:
    """Opening, then closing, with odd boxes; nothing lies outside of the raster."""
    opened = dilate(erode(flagged & inside, open_k), open_k) & inside
    return erode(dilate(opened, close_k) & inside, close_k)


def tile_runs(
    height: np.ndarray, at: tuple[int, int], core: tuple[int, int, int, int], raster: tuple[int, int], threshold: float, open_k: int, close_k: int
) -> dict[str, np.ndarray]:
    """Runs of the cells of one tile, with their component inside the tile.

    ``height`` starts at row and column ``at`` of the raster and holds the halo; ``core`` are the first and last-plus-one
    row and column of the tile itself.
    """
    r, c = at[0] + np.arange(height.shape[0]), at[1] + np.arange(height.shape[1])
    inside = ((r >= 0) & (r < raster[0]))[:, None] & ((c >= 0) & (c < raster[1]))[None, :]
    mask = clean_mask(height > threshold, inside, open_k, close_k)
    padded = np.pad(mask, 1)
    edge = mask & ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])
    window = (slice(core[0] - at[0], core[1] - at[0]), slice(core[2] - at[1], core[3] - at[1]))
    own, edge, v = mask[window], edge[window], height[window]
    steps = np.diff(np.pad(own, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(steps == 1)
    last = np.nonzero(steps == -1)[1] - 1
    before = lambda values: np.pad(np.cumsum(values, axis=1), ((0, 0), (1, 0)))
    over = lambda values: values[rows, last + 1] - values[rows, first]
    micro = np.round(v * 1e6).astype(np.int64)
    ends = np.stack([rows * own.shape[1] + first, rows * own.shape[1] + last + 1], axis=1).ravel()
    tops = np.maximum.reduceat(np.append(v.ravel(), -np.inf), ends)[::2] if len(rows) else np.zeros(0)
    return {
        "r": rows + core[0], "c1": first + core[2], "c2": last + core[2], "boundary_cells": over(before(edge.astype(np.int64))),
        "micro": over(before(micro)), "squares": run_squares(micro, rows, first, last), "top": tops,
    }


def run_squares(micro: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[Decimal]:
    """Exact sums of squared micrometres: high and low halves apart, so that nothing overflows."""
    high, low = micro >> 20, micro & ((1 << 20) - 1)
    parts = [np.pad(np.cumsum(p, axis=1), ((0, 0), (1, 0))) for p in (high * high, high * low, low * low)]
    hh, hl, ll = (p[rows, last + 1] - p[rows, first] for p in parts)
    return [Decimal((int(a) << 40) + (int(b) << 21) + int(c)) for a, b, c in zip(hh, hl, ll, strict=True)]


def tiled_runs(height: DataFrame, grids: DataFrame, threshold: Column | float, open_k: int, close_k: int, tile: int = TILE) -> DataFrame:
    """Runs of the cleaned mask with their component inside the tile, from one exchange of the cells.

    ``threshold`` is a number or a column of ``grids``.
    """
    halo = 2 * (open_k // 2) + 2 * (close_k // 2) + 1
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    geometry = bounded_broadcast(grids.select("survey_id", "width", "height", limit.cast("double").alias("_limit")))
    spread = lambda at, size: F.explode(F.sequence(
        F.greatest(F.floor((F.col(at) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(at) + halo) / tile), F.floor((F.col(size) - 1) / tile))
    ))
    value = F.coalesce("v", F.lit(0.0)).alias("v")
    placed = (
        height.join(geometry, "survey_id").select("survey_id", "r", "c", value, "width", "height", "_limit", spread("r", "height").alias("tr"))
        .select("*", spread("c", "width").alias("tc"))
    )
    arrow = to_arrow_schema(StructType.fromDDL(RUNS))

    def work(key: tuple, cells: pa.Table) -> pa.Table:
        survey, tr, tc = (k.as_py() for k in key)
        rows, cols, v = (cells.column(n).to_numpy() for n in ("r", "c", "v"))
        raster = (cells.column("height")[0].as_py(), cells.column("width")[0].as_py())
        at = (tr * tile - halo, tc * tile - halo)
        full = np.zeros((tile + 2 * halo, tile + 2 * halo))
        full[rows - at[0], cols - at[1]] = v
        core = (tr * tile, min((tr + 1) * tile, raster[0]), tc * tile, min((tc + 1) * tile, raster[1]))
        runs = tile_runs(full, at, core, raster, cells.column("_limit")[0].as_py(), open_k, close_k)
        n = len(runs["r"])
        runs["node"] = _band_roots(runs["r"], runs["c1"], runs["c2"], raster[1]) if n else np.zeros(0, np.int64)
        runs |= {"survey_id": np.full(n, survey), "tr": np.full(n, tr), "tc": np.full(n, tc)}
        return pa.table([pa.array(runs[f.name], f.type) for f in arrow], schema=arrow)

    return placed.groupBy("survey_id", "tr", "tc").applyInArrow(work, RUNS)


def seam_edges(runs: DataFrame, tile: int) -> DataFrame:
    """``(survey_id, a, b)``: components of neighbouring tiles that touch, also at corners."""
    across = lambda lo, hi: F.explode(
        F.sequence(F.floor(lo / COLUMN_BLOCK).cast("int"), F.floor(hi / COLUMN_BLOCK).cast("int"))
    )
    upper = runs.where(f"(r + 1) % {tile} = 0").select(
        "survey_id", (F.col("r") + 1).alias("r"), F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("node").alias("a"),
        across(F.col("c1") - 1, F.col("c2") + 1).alias("block"),
    )
    lower = runs.where(f"r % {tile} = 0").select("survey_id", "r", "c1", "c2", F.col("node").alias("b"), across(F.col("c1"), F.col("c2")).alias("block"))
    below = upper.join(lower, ["survey_id", "r", "block"]).where("c1 <= a2 + 1 and c2 >= a1 - 1").select("survey_id", "a", "b")
    left = runs.where(f"(c2 + 1) % {tile} = 0").select(
        "survey_id", (F.col("c2") + 1).alias("c1"), F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("r"), F.col("node").alias("a")
    )
    right = runs.where(f"c1 % {tile} = 0").select("survey_id", "c1", "r", F.col("node").alias("b"))
    return below.union(left.join(right, ["survey_id", "c1", "r"]).select("survey_id", "a", "b")).where("a <> b").distinct()


def segment(height: DataFrame, grids: DataFrame, threshold: Column | float = 0.5, open_k: int = 3, close_k: int = 7, tile: int = TILE) -> DataFrame:
    """Runs of all heaps with ``heap_id``, numbered by their first cell: one exchange of the cells, one of the seams, then the loop."""
    runs = cut_lineage(tiled_runs(height, grids, threshold, open_k, close_k, tile))
    edges = cut_lineage(seam_edges(runs, tile))
    named = runs.withColumn("root", F.col("node"))
    if not edges.isEmpty():
        roots = connected_components(edges)
        named = runs.join(roots, ["survey_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    ids = rank_roots(named.select("survey_id", "root").distinct(), grids)
    return cut_lineage(named.join(ids, ["survey_id", "root"]).drop("root", "node", "tr", "tc"))


def run_cells(runs: DataFrame) -> DataFrame:
    """Labelled cells ``(survey_id, r, c, heap_id)``."""
    return runs.select("survey_id", "r", F.explode(F.sequence("c1", "c2")).alias("c"), "heap_id")


def run_statistics(runs: DataFrame, grids: DataFrame) -> DataFrame:
    """The columns of ``segments.component_statistics`` and the box of every heap, from its runs alone.

    Heights lie on the micrometre grid, so all sums are whole numbers and exact.
    """
    n, total, squares = F.col("cells"), F.col("_micro"), F.col("_squares")
    variance = (n.cast("decimal(12,0)") * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    twice = total * 2 + n
    res = F.col("res")
    perimeter, area = F.col("boundary_cells") * res, n * res * res
    compactness = F.when(perimeter > 0, F.least(F.lit(1.0), F.lit(4.0) * F.pi() * area / (perimeter * perimeter))).otherwise(F.lit(0.0))
    sums = runs.groupBy("survey_id", "heap_id").agg(
        F.sum(F.col("c2") - F.col("c1") + 1).alias("cells"), F.sum("micro").alias("_micro"), F.sum("squares").cast("decimal(25,0)").alias("_squares"),
        F.max("top").alias("height_max"), F.sum("boundary_cells").alias("boundary_cells"),
        F.min("r").alias("_r1"), F.max("r").alias("_r2"), F.min("c1").alias("_c1"), F.max("c2").alias("_c2"),
    )
    geometry = bounded_broadcast(grids.select("survey_id", "res", "west", "north"))
    return sums.join(geometry, "survey_id").select(
        "survey_id", "heap_id", "cells", area.alias("area_m2"), compactness.alias("compactness"),
        ((twice - F.pmod(twice, n * 2)) / (n * 2) / 1e6).alias("height_mean"),
        (F.sqrt(F.greatest(variance, F.lit(0.0))) / n / 1e6).alias("height_std"), "height_max", "boundary_cells",
        (F.col("west") + F.col("_c1") * res).alias("bbox_min_e"), (F.col("north") - (F.col("_r2") + 1) * res).alias("bbox_min_n"),
        (F.col("west") + (F.col("_c2") + 1) * res).alias("bbox_max_e"), (F.col("north") - F.col("_r1") * res).alias("bbox_max_n"),
    )
