"""Operators on whole grid lines: sliding extremes of any kernel, stretching.

A line is one array of a row, as long as the raster is wide or high. A batch of lines is worked on as one flat array, so
lines of different surveys, lengths and kernels share every step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.runtime import bounded_broadcast

AXES = {"row": ("r", "c"), "column": ("c", "r")}
BATCH_CELLS = 1_000_000  # cells worked on at a time, unless one line alone is longer


def map_lines(cells: DataFrame, axis: str, constants: list[str], work: Callable, value: str = "v") -> DataFrame:
    """``(survey_id, r, c, v, known, *constants)`` after ``work`` on every line of ``cells`` with these columns.

    ``work(values, lengths, constants)`` gets lines end to end in order, NaN for NULL, and an array per constant; it returns the new values
    and lengths. ``known`` passes through if lengths stay, otherwise all cells are known. One shuffle.
    """
    across, along = AXES[axis]
    cell = F.struct(F.col(along).alias("at"), F.col(value).cast("double").alias("v"), "known")
    lines = cells.groupBy("survey_id", across, *constants).agg(F.array_sort(F.collect_list(cell)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("line").offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_CELLS, side="right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                line = part.column("line")
                flat, lengths = line.flatten(), np.diff(line.offsets.to_numpy())
                given = {n: part.column(n).to_numpy() for n in constants}
                values, longer = work(flat.field("v").to_numpy(zero_copy_only=False), lengths, given)
                same = longer is lengths
                at = flat.field("at") if same else pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in longer]))
                known = flat.field("known") if same else pa.array(np.ones(int(longer.sum()), bool))
                spread = lambda n: pa.array(np.repeat(part.column(n).to_numpy(), longer))  # noqa: B023, E731
                columns = {"survey_id": spread("survey_id"), across: spread(across), along: at, value: pa.array(values, mask=np.isnan(values)), "known": known}
                columns |= {n: spread(n) for n in constants}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    kinds = {"survey_id": "long", "r": "int", "c": "int", value: "double", "known": "boolean"} | {n: cells.schema[n].dataType.simpleString() for n in constants}
    names = list(kinds)
    return lines.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def sliding_extremes(flat: np.ndarray, lengths: np.ndarray, before: np.ndarray, kernels: np.ndarray, how: str) -> np.ndarray:
    """Least or greatest of ``kernels`` cells from ``before`` cells back on, clipped at the ends of the line; both given per line.

    Doubling tables: after j steps an entry holds the extreme of 2^j cells, and a frame is covered by the two entries of the
    largest power of two in its kernel. Steps grow with the logarithm of the kernel, for all lines together.
    """
    pick, fill = (np.minimum, np.inf) if how == "min" else (np.maximum, -np.inf)
    padded = lengths + kernels - 1
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(padded)
    opening = np.arange(len(flat)) + np.repeat(ends - padded - starts, lengths)  # where a cell's frame starts
    table = np.full(int(ends[-1]) if len(ends) else 0, fill)
    table[opening + np.repeat(before, lengths)] = flat
    level = np.frexp(kernels.astype(np.float64))[1] - 1
    levels, step = np.repeat(level, padded), 1
    for j in range(int(level.max(initial=0))):
        longer = table.copy()
        np.copyto(longer[:-step], pick(table[:-step], table[step:]), where=levels[:-step] > j)
        table, step = longer, step * 2
    return pick(table[opening], table[opening + np.repeat(kernels - (1 << level), lengths)])


def openings(dense: DataFrame, kernels: DataFrame, value: str = "v") -> DataFrame:
    """Grey openings of dense rasters, with the box of ``kernels(survey_id, k)`` for each survey: ``(survey_id, r, c, v)``.

    Box minimum, then box maximum with the mirrored frame; NULL cells take part as zero and are NULL again. All surveys share
    three shuffles, whatever their kernels.
    """

    def one(values, lengths, given, how, mirrored):
        k = given["k"].astype(np.int64)
        return sliding_extremes(values, lengths, k - 1 - k // 2 if mirrored else k // 2, k, how)

    cells = dense.join(bounded_broadcast(kernels.select("survey_id", F.col("k").cast("int").alias("k"))), "survey_id").select(
        "survey_id", "r", "c", F.coalesce(F.col(value), F.lit(0.0)).alias(value), F.col(value).isNotNull().alias("known"), "k"
    )
    rows = map_lines(cells, "row", ["k"], lambda v, n, g: (one(v, n, g, "min", False), n), value)
    both = lambda v, n, g: (one(one(v, n, g, "min", False), n, g, "max", True), n)
    columns = map_lines(rows, "column", ["k"], both, value)
    opened = map_lines(columns, "row", ["k"], lambda v, n, g: (one(v, n, g, "max", True), n), value)
    return opened.select("survey_id", "r", "c", F.when(F.col("known"), F.col(value)).alias(value))


def stretched(flat: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Lines read at ``wanted`` even places from their first to their last cell, linear in between; NaN beside a NaN that counts."""
    starts, own = np.cumsum(lengths) - lengths, np.cumsum(wanted) - wanted
    i = np.arange(int(wanted.sum())) - np.repeat(own, wanted)
    ratio = np.repeat(lengths - 1, wanted)
    at = np.where(np.repeat(wanted, wanted) > 1, i * ratio / np.maximum(np.repeat(wanted, wanted) - 1, 1), 0.0)
    low = np.floor(at).astype(np.int64)
    share = at - low
    first = np.repeat(starts, wanted)
    a, b = flat[first + low], flat[first + np.minimum(low + 1, ratio)]
    return np.where(share == 0, a, a * (1 - share) + b * share)


def stretch(coarse: DataFrame, grids: DataFrame, value: str = "v") -> DataFrame:
    """Dense coarse rasters stretched to ``grids``, bilinear: first and last cells of both coincide. Two shuffles, no join of cells."""
    cells = coarse.join(bounded_broadcast(grids.select("survey_id", "height", "width")), "survey_id").select(
        "survey_id", "r", "c", F.col(value).cast("double").alias(value), F.lit(True).alias("known"), "height", "width"
    )
    sides = ["height", "width"]
    wide = map_lines(cells, "row", sides, lambda v, n, g: (stretched(v, n, g["width"].astype(np.int64)), g["width"].astype(np.int64)), value)
    full = map_lines(wide, "column", sides, lambda v, n, g: (stretched(v, n, g["height"].astype(np.int64)), g["height"].astype(np.int64)), value)
    return full.select("survey_id", "r", "c", value)
