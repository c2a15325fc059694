"""Raster neighbourhood operators as window frames.

Every structuring element is a box, so each operator is a row pass and a column
pass. A window partition is one grid line ``(survey_id, r)`` or
``(survey_id, c)``: its size is the width or height of the site, never a whole
survey. All frames count ROWS, so the input must be dense (``dense_cells``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from moundlake.operators.graph import connected_components
from moundlake.runtime import cut_lineage

# Frames up to this length are re-evaluated per row; longer ones use two scans.
DIRECT_FRAME = 16


def row_line() -> WindowSpec:
    return Window.partitionBy("survey_id", "r").orderBy("c")


def column_line() -> WindowSpec:
    return Window.partitionBy("survey_id", "c").orderBy("r")


_AXES = {"row": ("r", "c", row_line), "column": ("c", "r", column_line)}


def dense_cells(cells: DataFrame, grids: DataFrame, axis: str = "row") -> DataFrame:
    """One row per grid cell; cells without a value become NULL.

    Skeleton and values meet in one shuffle by grid line (rows, or columns when the
    next window runs down the columns), and that window reuses the partitioning.
    """
    schema = cells.schema
    values = [name for name in cells.columns if name not in ("survey_id", "r", "c")]
    across, along, _ = _AXES[axis]
    size = {"r": "height", "c": "width"}
    lines = grids.select(
        "survey_id", size[along], F.explode(F.sequence(F.lit(0), F.col(size[across]) - 1)).alias(across)
    ).repartition("survey_id", across)
    skeleton = lines.select(
        "survey_id", across, F.explode(F.sequence(F.lit(0), F.col(size[along]) - 1)).alias(along),
        *[F.lit(None).cast(schema[name].dataType).alias(name) for name in values],
    )
    return (
        skeleton.unionByName(cells)
        .repartition("survey_id", across)
        .groupBy("survey_id", "r", "c")
        .agg(*[F.max(name).alias(name) for name in values])
    )


def sliding(df: DataFrame, value: str, out: str, axis: str, before: int, after: int, how: str) -> DataFrame:
    """Min or max over the frame ``[-before, +after]`` along one axis, clipped at the edges.

    Long frames are answered from running extremes of blocks as long as the frame
    (one forward, one backward), so the cost per cell does not grow with the kernel.
    """
    across, along, line = _AXES[axis]
    pick = F.min if how == "min" else F.max
    length = before + after + 1
    if length <= DIRECT_FRAME:
        return df.withColumn(out, pick(value).over(line().rowsBetween(-before, after)))
    block = F.floor(F.col(along) / F.lit(length))
    keys = ["survey_id", across]
    forward = Window.partitionBy(*keys, "_block").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    backward = (
        Window.partitionBy(*keys, "_block").orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
    )
    from_end = Window.partitionBy(*keys).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
    scanned = (
        # one shuffle by grid line serves the block windows and the line windows
        df.repartition(*keys)
        .withColumn("_block", block)
        .withColumns({"_ahead": pick(value).over(forward), "_behind": pick(value).over(backward)})
        .withColumn("_line_end", F.first("_ahead").over(from_end))
    )
    right = F.coalesce(F.lead("_ahead", after).over(line()), F.col("_line_end"))
    left = F.lag("_behind", before).over(line())
    both = F.least if how == "min" else F.greatest
    return scanned.withColumn(out, both(right, left)).drop("_block", "_ahead", "_behind", "_line_end")


def grey_erosion_frames(k: int) -> tuple[int, int]:
    return k // 2, k - 1 - k // 2


def grey_opening(df: DataFrame, value: str, out: str, k: int, nulls_as_zero: bool = True) -> DataFrame:
    """k x k grey opening: box minimum, then box maximum with the mirrored frame.

    NULL cells take part as zero and are NULL again in the result; with
    ``nulls_as_zero=False`` they are skipped instead.
    """
    before, after = grey_erosion_frames(k)
    start = F.coalesce(F.col(value), F.lit(0.0)) if nulls_as_zero else F.col(value)
    work = df.withColumn("_w", start)
    work = sliding(work, "_w", "_w", "row", before, after, "min")
    work = sliding(work, "_w", "_w", "column", before, after, "min")
    work = sliding(work, "_w", "_w", "column", after, before, "max")
    work = sliding(work, "_w", "_w", "row", after, before, "max")
    return work.withColumn(out, F.when(F.col(value).isNotNull(), F.col("_w"))).drop("_w")


def _dilate(df: DataFrame, flag: str, axis: str, reach: int) -> DataFrame:
    return df.withColumn(flag, F.max(flag).over(_AXES[axis][2]().rowsBetween(-reach, reach)))


def _erode(df: DataFrame, flag: str, axis: str, reach: int) -> DataFrame:
    frame = _AXES[axis][2]().rowsBetween(-reach, reach)
    inside = F.count(F.lit(1)).over(frame) == F.lit(2 * reach + 1)
    return df.withColumn(flag, F.when(inside, F.min(flag).over(frame)).otherwise(F.lit(0)))


def binary_opening(df: DataFrame, flag: str, k: int = 3) -> DataFrame:
    """Erosion then dilation of a 0/1 column by an odd k x k box; outside counts as 0."""
    reach = k // 2
    for step, axis in ((_erode, "row"), (_erode, "column"), (_dilate, "column"), (_dilate, "row")):
        df = step(df, flag, axis, reach)
    return df


def binary_closing(df: DataFrame, flag: str, k: int = 7) -> DataFrame:
    """Dilation then erosion by an odd k x k box; the erosion clears the outer k//2 cells."""
    reach = k // 2
    for step, axis in ((_dilate, "row"), (_dilate, "column"), (_erode, "column"), (_erode, "row")):
        df = step(df, flag, axis, reach)
    return df


def gradient(df: DataFrame, value: str, res: Column) -> DataFrame:
    """Adds ``gx`` (along columns) and ``gy`` (along rows): central differences, one-sided at edges."""

    def slope(line: WindowSpec) -> Column:
        ahead, behind = F.lead(value).over(line), F.lag(value).over(line)
        here = F.col(value)
        return (
            F.when(behind.isNull() & ahead.isNull(), F.lit(0.0))
            .when(behind.isNull(), (ahead - here) / res)
            .when(ahead.isNull(), (here - behind) / res)
            .otherwise((ahead - behind) / (F.lit(2.0) * res))
        )

    return df.withColumns({"gx": slope(row_line()), "gy": slope(column_line())})


def boundary_flag(df: DataFrame, label: str, out: str = "is_boundary") -> DataFrame:
    """True where a labelled cell has a 4-neighbour with another label; outside counts as 0.

    Works on labelled cells alone: a missing neighbour row is background.
    """
    across = Window.partitionBy("survey_id", "r").orderBy("c")
    down = Window.partitionBy("survey_id", "c").orderBy("r")

    def same(line: WindowSpec, along: str, step: int) -> Column:
        other = F.lag(F.struct(F.col(along).alias("at"), F.col(label).alias("label")), step).over(line)
        return F.coalesce((other["at"] == F.col(along) - step) & (other["label"] == F.col(label)), F.lit(False))

    level = same(across, "c", 1) & same(across, "c", -1)
    upright = same(down, "r", 1) & same(down, "r", -1)
    return df.withColumn(out, (F.col(label) > 0) & ~(level & upright))


def local_maxima(df: DataFrame, value: str, distance: int, out: str = "is_peak") -> DataFrame:
    """True where a cell equals the maximum of its (2d+1) x (2d+1) box and is not in the border band."""
    work = sliding(df.withColumn("_m", F.col(value)), "_m", "_m", "row", distance, distance, "max")
    work = sliding(work, "_m", "_m", "column", distance, distance, "max")
    rows, cols = Window.partitionBy("survey_id", "c"), Window.partitionBy("survey_id", "r")
    inner = (
        (F.col("r") >= distance)
        & (F.col("c") >= distance)
        & (F.col("r") <= F.max("r").over(rows) - distance)
        & (F.col("c") <= F.max("c").over(cols) - distance)
    )
    return work.withColumn("_inner", inner).withColumn(
        out, F.coalesce((F.col("_m") == F.col(value)) & (F.col(value) > 0) & F.col("_inner"), F.lit(False))
    ).drop("_m", "_inner")


def plateau_tops(cells: DataFrame, value: str) -> DataFrame:
    """One of the given cells for every plateau of theirs, its first: neighbours (also at corners) of equal value are one plateau.

    ``cells`` are few, such as the local maxima of a raster.
    """
    cells = cut_lineage(cells)
    number = F.shiftleft(F.col("r").cast("long"), 32) + F.col("c")
    named = cells.select("survey_id", "r", "c", F.col(value).alias("_v"), number.alias("a"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    beside = named.select("survey_id", "_v", "a", "r", "c", F.explode(steps).alias("s")).select(
        "survey_id", "_v", "a", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")
    )
    edges = beside.join(named.select("survey_id", "_v", "r", "c", F.col("a").alias("b")), ["survey_id", "_v", "r", "c"]).select("survey_id", "a", "b")
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return cells
    later = connected_components(edges).where("node <> root").select("survey_id", F.col("node").alias("_number"))
    return cells.withColumn("_number", number).join(later, ["survey_id", "_number"], "left_anti").drop("_number")


def block_min(df: DataFrame, value: str, factor: Column | int) -> DataFrame:
    """Block-reduced minimum; ragged blocks at the edges use the cells they have."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    return df.groupBy(
        "survey_id", F.floor(F.col("r") / f).cast("int").alias("r"), F.floor(F.col("c") / f).cast("int").alias("c")
    ).agg(F.min(value).alias(value))
