"""Catalogue of drone-export folders from a file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where an export folder keeps its assets.
DSM_PRIMARY = "map/dsm.tif"
DSM_FALLBACK = "models/pc/0/terra_dem/dem.tif"
ORTHO = "map/result.tif"
CLOUD = "models/pc/0/terra_las/cloud_merged.las"
SENTINEL = "map/2dPipeline_done"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, relpath, mtime, size) below ``root``; contents are not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # paths come back as URIs: cut everything up to and including the root
    tail = F.expr("substring(path, instr(path, %r) + %d)" % (base, len(base)))
    return files.select(
        F.substring_index(tail, "/", 1).alias("folder"),
        F.regexp_replace(tail, "^[^/]+/", "").alias("relpath"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )


def scan_folders(listing: DataFrame) -> DataFrame:
    """One manifest row per folder: assets, completion, survey date, warnings, error."""

    def has(rel: str) -> Column:
        return F.coalesce(F.bool_or(F.col("relpath") == rel), F.lit(False))

    found = listing.groupBy("folder").agg(
        has(DSM_PRIMARY).alias("_dsm"), has(DSM_FALLBACK).alias("_dem"), has(ORTHO).alias("_ortho"),
        has(CLOUD).alias("_cloud"), has(SENTINEL).alias("pipeline_complete"),
        *[
            F.min(F.when(F.col("relpath") == rel, F.col("mtime"))).alias(name)
            for rel, name in ((DSM_PRIMARY, "_t_dsm"), (DSM_FALLBACK, "_t_dem"), (ORTHO, "_t_ortho"), (CLOUD, "_t_cloud"))
        ],
    )
    dsm = F.when(F.col("_dsm"), F.lit(DSM_PRIMARY)).when(F.col("_dem"), F.lit(DSM_FALLBACK))
    error = (
        F.when(dsm.isNull(), F.lit("DSM not found"))
        .when(~F.col("_ortho"), F.lit("orthophoto not found"))
        .when(~F.col("_cloud"), F.lit("point cloud not found"))
    )
    earliest = F.least(
        F.when(F.col("_dsm"), F.col("_t_dsm")).otherwise(F.col("_t_dem")), F.col("_t_ortho"), F.col("_t_cloud")
    )
    return found.select(
        "folder",
        dsm.alias("dsm_path"),
        F.when(F.col("_ortho"), F.lit(ORTHO)).alias("orthophoto_path"),
        F.when(F.col("_cloud"), F.lit(CLOUD)).alias("las_path"),
        "pipeline_complete",
        survey_date(earliest).alias("survey_date"),
        F.array_compact(
            F.array(
                F.when(~F.col("_dsm") & F.col("_dem"), F.lit("preferred DSM missing, fallback used")),
                F.when(~F.col("pipeline_complete"), F.lit("completion marker missing")),
            )
        ).alias("warnings"),
        error.alias("error"),
    )


def survey_date(mtime: Column) -> Column:
    """UTC date of a time stamp (the session runs in UTC)."""
    return F.to_date(mtime)


def resolve_crs(*candidates: Column) -> Column:
    """First known CRS: surface sidecar, orthophoto sidecar, surface tags, cloud header."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
