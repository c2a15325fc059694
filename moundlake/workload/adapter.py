"""Survey tables derived from the given TPC-H-like tables.

Points come from ``lineitem``: two surveys (a baseline and a later one) per site,
one site per 150,000 order keys, so the number of sites grows with the data. The
scene holds four solids on flat ground, with up to 9 mm of noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_ORDERS = 150_000
WEST, SOUTH = 500000.0, 5000000.0
UNITS = 4000          # 5 cm units along each side of the 200 m site
UNIT = 0.05
CELL_UNITS = 40  # cells of 2 m, whatever the number of points
BASE = 100.0
CRS = "EPSG:32632"

# Ground-reference boxes, flat in both surveys (min_x, min_y, max_x, max_y), local metres.
GROUND_BOXES = [(90.0, 20.0, 110.0, 40.0), (20.0, 90.0, 40.0, 110.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """survey_id, u, v, z_mm, cls in integer units, plus any ``lineitem`` columns asked for."""
    li = table(spark, sf_dir, "lineitem")
    # inline() makes u, v and z_mm plain columns: a filter above is not rewritten in terms
    # of their formulas, which would swell it beyond what the JIT compiles
    base = li.select(
        F.expr(f"1 + l_orderkey % 2 + 2 * (l_orderkey div {SITE_ORDERS})").alias("survey_id"),
        F.expr(
            """inline(array(named_struct(
              'u', (l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 4000,
              'v', (l_orderkey*15485863 + l_suppkey*32452843 + l_partkey*49979687 + l_linenumber*86028121) % 4000)))"""
        ),
        "l_quantity",
        *extra,
    )
    heights = base.withColumn("lx", F.expr("u * 0.05D")).withColumn("ly", F.expr("v * 0.05D"))
    heights = heights.withColumn("odd", F.expr("survey_id % 2 = 1")).withColumn(
        "h",
        F.expr(
            """greatest(0D,
              5D * (1D - sqrt((lx-50D)*(lx-50D) + (ly-50D)*(ly-50D)) / 15D),
              case when (lx-150D)*(lx-150D) + (ly-50D)*(ly-50D) < if(odd, 144D, 174.24D)
                   then sqrt(if(odd, 144D, 174.24D) - ((lx-150D)*(lx-150D) + (ly-50D)*(ly-50D))) else 0D end,
              6D * (1D - greatest(abs(lx-50D), abs(ly-150D)) / if(odd, 10D, 9.13D)),
              case when odd
                   then least(4D, 0.4D * (18D - sqrt((lx-150D)*(lx-150D) + (ly-150D)*(ly-150D))))
                   else 3D * (1D - sqrt((lx-100D)*(lx-100D) + (ly-100D)*(ly-100D)) / 10D) end)"""
        ),
    )
    # heights and class come out of inline() as plain columns: a filter on the class must not be rewritten in terms of the
    # formula of the heights. Ground is where every solid has height 0 as computed, also on the rims, where 5 cm units times
    # 0.05 are not exact.
    return heights.select(
        "survey_id", "u", "v",
        F.expr(
            """inline(array(named_struct(
              'z_mm', cast(floor(100000D + h*1000D + 0.5D) as bigint) + cast(l_quantity as bigint) % 10,
              'cls', if(h = 0D, 2, 1))))"""
        ),
        *extra,
    )


def points(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Points in world coordinates, at the middle of their 5 cm unit."""
    return raw_points(spark, sf_dir, *extra).select(
        "survey_id",
        F.expr(f"{WEST}D + (u + 0.5D) * {UNIT}D").alias("x"),
        F.expr(f"{SOUTH}D + (v + 0.5D) * {UNIT}D").alias("y"),
        F.expr("z_mm / 1000D").alias("z"),
        F.col("cls").alias("classification"),
        *extra,
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid geometry per survey, with cells of CELL_UNITS."""
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr(f"1 + l_orderkey % 2 + 2 * (l_orderkey div {SITE_ORDERS})").alias("survey_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    units = F.lit(CELL_UNITS)
    side = (F.lit(UNITS) / units).cast("int")
    return counted.select(
        "survey_id",
        F.lit(WEST).alias("west"),
        F.lit(SOUTH + UNITS * UNIT).alias("north"),
        (units * F.lit(UNIT)).alias("res"),
        side.alias("width"),
        side.alias("height"),
        F.lit(CRS).alias("crs"),
    )


def bases(grids_df: DataFrame, base: float = BASE) -> DataFrame:
    return grids_df.select("survey_id", F.lit(base).alias("base"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per region, with its ordered material categories."""
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("project_id"),
        F.col("r_name").alias("name"),
        F.array(*[F.lit(c) for c in CATEGORIES]).alias("material_categories"),
        F.expr("timestamp'2025-01-01 08:00:00' + make_interval(0, 0, 0, r_regionkey % 3)").alias("created_at"),
    )


# The categories of the fixture projects.
CATEGORIES = ["sabbia", "ghiaia", "argilla", "scorie", "carbone"]


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey per nation, dated from its key."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("survey_id"),
        F.col("n_regionkey").cast("long").alias("project_id"),
        F.expr("date_add(date'2025-01-01', n_nationkey)").alias("survey_date"),
        F.expr("case when n_nationkey % 4 = 0 then null else 100D + n_nationkey end").alias("base_elevation"),
    )


def heap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heap record per order: integer formulas scaled to the published decimals."""
    cents = "cast(round(o_totalprice * 100D) as bigint)"
    category = "case when o_orderkey % 5 = 4 then null else element_at(array('sabbia','ghiaia','argilla','scorie','carbone'), cast(o_orderkey % 7 % 5 + 1 as int)) end"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("heap_id"),
        F.expr("o_custkey % 25").alias("survey_id"),
        F.expr("concat('Cumulo ', o_orderkey)").alias("label"),
        F.expr(f"({cents} % 1000003) / 1000D").alias("volume_m3"),
        F.expr(f"({cents} % 90001) / 1000D").alias("planimetric_area_m2"),
        F.expr(f"({cents} % 90001 + o_orderkey % 977) / 1000D").alias("surface_area_m2"),
        F.expr(f"({cents} % 1201) / 100D").alias("max_height_m"),
        F.expr(f"({cents} % 601) / 100D").alias("mean_height_m"),
        F.expr("(10000 + o_custkey % 500) / 100D").alias("base_elevation_m"),
        F.expr("500000D + (o_orderkey * 7919 % 200000) / 1000D").alias("centroid_e"),
        F.expr("5000000D + (o_orderkey * 104729 % 200000) / 1000D").alias("centroid_n"),
        F.expr(category).alias("material_category"),
        F.expr("case when o_orderkey % 11 = 0 then null else (o_orderkey % 10) / 10D end").alias("material_confidence"),
        F.expr("o_orderkey % 3 = 0").alias("is_manually_confirmed"),
        F.expr("o_orderkey % 8 = 0").alias("is_excluded"),
        F.expr("case o_orderkey % 3 when 0 then 'manual' when 1 then 'vlm:base' end").alias("classified_by"),
    )
