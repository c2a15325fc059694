"""Exact interpolated percentiles, for small and for unbounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundlake.runtime import bounded_broadcast, cut_lineage

MICRON = 6  # decimals kept in every height raster


def on_grid(value: Column) -> Column:
    """``round(value, 6)``; heights that lie on the micrometre grid already, the usual case, skip the slow decimal arithmetic.

    Under 1e8 a micrometre has at most 15 digits, so the double nearest to it is what rounding gives back.
    """
    snapped = F.rint(value * 1e6) / 1e6
    return F.when((snapped == value) & (F.abs(value) < 1e8), value).otherwise(F.round(value, MICRON))


# Metres of a first bucket of the heights in a cell: a cell has few of them, and one holds 62,500 heights at most.
CELL_STEP = 0.0625
HOT_ROWS = 1 << 18  # rows of a cell from which on no window takes it whole


def cell_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, weight: str | None = None, hot: int = HOT_ROWS
) -> DataFrame:
    """Interpolated percentile per raster cell, for all cells at once and cells of any size.

    Rows are counted per grid line (all keys but the last) first, and per cell in lines of more than ``hot`` rows. Cells of at most ``hot`` rows, the usual case, are put in order by one shuffle and one
    sort. Larger ones take the selection of ``group_percentile`` with buckets of a few centimetres: equal heights are counted
    with map-side combine and spread by (cell, height), buckets are summed per cell, and only the bucket of the wanted rank is put in
    order. A cell that holds a third of all points, at heights that never repeat, reaches no window whole.
    """
    keys = list(keys)
    over = lambda rows, by: cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*by))
    lines = over(df, keys[:-1])
    if lines.isEmpty():
        return _ordered_percentile(df, keys, value, q, out, weight)
    few = bounded_broadcast(over(df.join(bounded_broadcast(lines), keys[:-1], "left_semi"), keys))
    return _ordered_percentile(df.join(few, keys, "left_anti"), keys, value, q, out, weight).unionByName(
        group_percentile(df.join(few, keys, "left_semi"), keys, value, q, out, CELL_STEP, weight)
    )


def _plain_rows(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    """``(keys, _v, _w)`` without nulls; inline() makes plain columns, whose formulas the filters would repeat otherwise."""
    row = F.struct(*keys, on_grid(F.col(value).cast("double")).alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"))
    return df.select(F.inline(F.array(row))).where(" and ".join(f"`{name}` is not null" for name in [*keys, "_v"]))


def _ordered_percentile(df: DataFrame, keys: list[str], value: str, q: float, out: str, weight: str | None) -> DataFrame:
    """Percentile per key of groups small enough for a window."""
    order = Window.partitionBy(*keys).orderBy("_v")
    ranked = _plain_rows(df, keys, value, weight).select(
        *keys, "_v", "_w",
        F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    position = F.lit(q) * (F.col("_total") - 1)
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_w")) & (rank < F.col("_upto")), F.col("_v")))
    return (
        ranked.groupBy(*keys)
        .agg(at(F.floor(position)).alias("_vl"), at(F.ceil(position)).alias("_vh"), F.max(position - F.floor(position)).alias("_frac"))
        .select(*keys, F.round(F.col("_vl") + (F.col("_vh") - F.col("_vl")) * F.col("_frac"), MICRON).alias(out))
    )


def group_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, step: float = 1e-3, weight: str | None = None
) -> DataFrame:
    """Percentile per key of any size (all cells of a survey), never in one task.

    Distinct values are counted in parallel, summed per bucket of ``step`` metres,
    and only the one or two buckets around the wanted rank are ordered. The bucket
    table is bounded by the relief of the site, a bucket by the micrometre grid. With a ``weight``
    column a row stands for so many equal values.
    """
    keys = list(keys)
    # both uses of the counts carry the same filters, so that they share one scan and one exchange
    counts = (
        _plain_rows(df, keys, value, weight)
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_n"))
        .withColumn("_b", F.floor(F.col("_v") / F.lit(step)))
        .where("_b is not null")
    )
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    position = F.lit(q) * (F.col("_total") - 1)
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(running) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_lo", F.floor(position))
        .withColumn("_hi", F.ceil(position))
        .withColumn("_frac", position - F.floor(position))
        .where(
            ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < F.col("_before") + F.col("_bn")))
            | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < F.col("_before") + F.col("_bn")))
        )
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        # one or two buckets a key are hashed; the counts are put in order once, by the window
        counts.join(buckets.hint("shuffle_hash"), [*keys, "_b"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def at(rank: str):
        return F.max(F.when(F.col(rank).between(F.col("_first"), F.col("_last")), F.col("_v")))

    return (
        ranked.groupBy(*keys)
        .agg(at("_lo").alias("_vl"), at("_hi").alias("_vh"), F.max("_frac").alias("_frac"))
        .select(*keys, F.round(F.col("_vl") + (F.col("_vh") - F.col("_vl")) * F.col("_frac"), MICRON).alias(out))
    )


def exact_mean(height: Column, counted: Column) -> Column:
    """Mean of the counted heights, rounded half up to a whole micrometre; 0 when none is counted.

    Heights lie on the micrometre grid, so their sum is a whole number and the mean depends on
    neither the order of the sum nor on binary fractions.
    """
    total = F.sum(F.when(counted, F.round(height * 1e6)).otherwise(0).cast("long"))
    n = F.count_if(counted)
    twice = total * 2 + n
    # n is 1 at least in the division, so that an empty group doesn't fail
    whole = (twice - F.pmod(twice, F.greatest(n * 2, F.lit(1)))) / F.greatest(n * 2, F.lit(1))
    return F.when(n > 0, whole / 1e6).otherwise(F.lit(0.0))
