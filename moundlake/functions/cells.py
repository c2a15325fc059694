"""Column expressions of the grid: world to cell, cell to world, affine maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_column(x: Column, west: Column, res: Column) -> Column:
    return F.floor((x - west) / res).cast("int")


def cell_row(y: Column, north: Column, res: Column) -> Column:
    return F.floor((north - y) / res).cast("int")


def centre_east(c: Column, west: Column, res: Column) -> Column:
    return west + (c + F.lit(0.5)) * res


def centre_north(r: Column, north: Column, res: Column) -> Column:
    return north - (r + F.lit(0.5)) * res


def affine(px: Column, py: Column, a, b, c, d, e, f) -> tuple[Column, Column]:
    """Pixel (px, py) to world: (a*px + b*py + c, d*px + e*py + f)."""
    return a * px + b * py + c, d * px + e * py + f


def affine_inverse(x: Column, y: Column, a, b, c, d, e, f) -> tuple[Column, Column]:
    """World to pixel for the affine map above."""
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def clean_height(v: Column, nodata: float = -9999.0) -> Column:
    """nodata to NULL."""
    return F.when(F.abs(v - F.lit(nodata)) <= F.lit(1e-6 * abs(nodata)), None).otherwise(v)


def finite_or_zero(v: Column) -> Column:
    """NULL, NaN and infinities count as height zero."""
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(usable, v).otherwise(F.lit(0.0))
