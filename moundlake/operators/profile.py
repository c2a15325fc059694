"""Cross-section profiles along polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundlake.operators.surface import sample_rasters
from moundlake.runtime import bounded_broadcast


def line_errors(lines: DataFrame) -> DataFrame:
    """Adds ``error``: too few points, zero length, or a spacing that is not positive."""
    length = F.aggregate(
        F.zip_with(
            F.slice("coords", F.lit(1), F.greatest(F.size("coords") - 1, F.lit(0))),
            F.slice("coords", F.lit(2), F.greatest(F.size("coords") - 1, F.lit(0))),
            lambda p, q: F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])),
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return lines.withColumn("length", F.when(F.size("coords") >= 2, length)).withColumn(
        "error",
        F.when(F.col("coords").isNull() | (F.size("coords") < 2), F.lit("line needs at least 2 points"))
        .when(F.col("length") <= 0, F.lit("line has zero length"))
        .when(F.col("spacing") <= 0, F.lit("spacing must be positive")),
    )


def line_samples(lines: DataFrame) -> DataFrame:
    """Evenly spaced samples: (survey_id, section_id, i, distance, x, y).

    ``lines(survey_id, section_id, coords, spacing)``; n = max(2, ceil(L/spacing)+1).
    The samples of a segment are generated from its own distance range, so there
    is no join of samples against segments.
    """
    valid = line_errors(lines).where("error is null")
    n = F.greatest(F.lit(2), (F.ceil(F.col("length") / F.col("spacing")) + 1).cast("int"))
    segments = valid.withColumn("n", n).select(
        "survey_id", "section_id", "length", "n", F.size("coords").alias("_k"),
        F.posexplode(
            F.zip_with(
                F.slice("coords", F.lit(1), F.size("coords") - 1),
                F.slice("coords", F.lit(2), F.size("coords") - 1),
                lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
            )
        ).alias("seg", "e"),
    )
    span = F.sqrt(
        (F.col("e.x2") - F.col("e.x1")) * (F.col("e.x2") - F.col("e.x1"))
        + (F.col("e.y2") - F.col("e.y1")) * (F.col("e.y2") - F.col("e.y1"))
    )
    along = Window.partitionBy("survey_id", "section_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.withColumn("span", span).where("span > 0").withColumn("end", F.sum("span").over(along)).withColumn(
        "start", F.col("end") - F.col("span")
    )
    step = F.col("length") / (F.col("n") - 1)
    is_last = F.col("seg") == F.max("seg").over(Window.partitionBy("survey_id", "section_id"))
    first = F.ceil(F.col("start") / step - F.lit(1e-9)).cast("int")
    last = F.when(is_last, F.col("n") - 1).otherwise(F.ceil(F.col("end") / step - F.lit(1e-9)).cast("int") - 1)
    samples = placed.withColumn("_f", F.when(F.col("start") <= 0, F.lit(0)).otherwise(first)).withColumn("_l", last).where(
        "_f <= _l"
    )
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("distance") - F.col("start")) / F.col("span")))
    return (
        samples.withColumn("i", F.explode(F.sequence("_f", "_l")))
        .withColumn("distance", F.col("length") * F.col("i") / (F.col("n") - 1))
        .select(
            "survey_id", "section_id", "i", "n", "length", "distance",
            (F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * t).alias("x"),
            (F.col("e.y1") + (F.col("e.y2") - F.col("e.y1")) * t).alias("y"),
        )
    )


def profiles(lines: DataFrame, surface: DataFrame, terrain: DataFrame, grids: DataFrame) -> DataFrame:
    """Samples with surface and terrain heights; an integer (row, col) is a sample location."""
    geometry = bounded_broadcast(grids.select("survey_id", "west", "north", "res"))
    samples = (
        line_samples(lines)
        .join(geometry, "survey_id")
        .withColumn("sample_id", F.struct("section_id", "i"))
        .withColumn("row", (F.col("north") - F.col("y")) / F.col("res"))
        .withColumn("col", (F.col("x") - F.col("west")) / F.col("res"))
        .drop("west", "north", "res")
    )
    return sample_rasters(samples, {"dsm_z": surface, "dtm_z": terrain}, grids).drop("row", "col", "sample_id")


def section_summary(profile: DataFrame, compat_nan_as_zero: bool = False) -> DataFrame:
    """Trapezoid area of the positive difference and its maximum, per section.

    Missing samples break the integral; with ``compat_nan_as_zero`` they count as
    height zero.
    """
    line = Window.partitionBy("survey_id", "section_id").orderBy("i")
    diff = F.col("dsm_z") - F.col("dtm_z")
    positive = F.when(diff > 0, diff).when(diff.isNotNull() | F.lit(compat_nan_as_zero), F.lit(0.0))
    stepped = (
        profile.withColumn("h", positive)
        .withColumn("_ph", F.lag("h").over(line))
        .withColumn("_pd", F.lag("distance").over(line))
    )
    piece = F.lit(0.5) * (F.col("h") + F.col("_ph")) * (F.col("distance") - F.col("_pd"))
    return stepped.groupBy("survey_id", "section_id").agg(
        F.round(F.coalesce(F.sum(piece), F.lit(0.0)), 4).alias("section_area"),
        F.round(F.coalesce(F.max("h"), F.lit(0.0)), 4).alias("max_height"),
        F.round(F.max("length"), 4).alias("length"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def profile_arrays(profile: DataFrame) -> DataFrame:
    """Array form of a profile: parallel arrays rounded to 4 decimals, in sample order."""
    packed = F.array_sort(F.collect_list(F.struct("i", "distance", "dsm_z", "dtm_z")))
    return profile.groupBy("survey_id", "section_id").agg(packed.alias("s")).select(
        "survey_id", "section_id",
        F.transform("s", lambda k: k["distance"]).alias("distance"),
        F.transform("s", lambda k: F.round(k["dsm_z"], 4)).alias("dsm_z"),
        F.transform("s", lambda k: F.round(k["dtm_z"], 4)).alias("dtm_z"),
    )
