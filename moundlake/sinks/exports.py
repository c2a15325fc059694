"""Exports of heap records, rasters and results documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundlake.functions.formats import fixed

# CSV headers with the source column and its decimals.
CSV_FIELDS = [
    ("ID", "heap_id", None),
    ("Volume_m3", "volume_m3", 3),
    ("Area_planimetrica_m2", "planimetric_area_m2", 3),
    ("Area_superficiale_m2", "surface_area_m2", 3),
    ("Altezza_max_m", "max_height_m", 2),
    ("Altezza_media_m", "mean_height_m", 2),
    ("Quota_base_mslm", "base_elevation_m", 2),
    ("Centroide_E", "centroid_e", 6),
    ("Centroide_N", "centroid_n", 6),
    ("BBox_minE", "bbox_min_e", 6),
    ("BBox_minN", "bbox_min_n", 6),
    ("BBox_maxE", "bbox_max_e", 6),
    ("BBox_maxN", "bbox_max_n", 6),
    ("Categoria_materiale", "material_category", None),
    ("Data_rilievo", "survey_date", None),
]

# Attribute names of at most ten characters.
SHORT_NAMES = {
    "id": "id",
    "label": "label",
    "volume_m3": "vol_m3",
    "planimetric_area_m2": "area_pl_m2",
    "surface_area_m2": "area_sf_m2",
    "max_height_m": "h_max_m",
    "mean_height_m": "h_mean_m",
    "base_elevation_m": "base_m",
    "centroid_e": "centr_e",
    "centroid_n": "centr_n",
    "material_category": "mat_cat",
    "material_confidence": "mat_conf",
    "is_manually_confirmed": "confirmed",
    "survey_date": "surv_date",
}
NODATA = -9999.0


def csv_rows(heaps: DataFrame, *keys: str) -> DataFrame:
    """Heap records as CSV text columns under the published headers."""
    def cell(name: str, decimals: int | None) -> Column:
        if decimals is not None:
            return fixed(F.col(name), decimals)
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return heaps.select(*keys, *[cell(name, d).alias(header) for header, name, d in CSV_FIELDS])


def write_csv(heaps: DataFrame, path: str) -> None:
    """Semicolon CSV, one folder per survey; the header starts with a byte-order mark."""
    rows = csv_rows(heaps, "survey_id").withColumnRenamed("ID", "﻿ID")
    rows.write.mode("overwrite").partitionBy("survey_id").option("sep", ";").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def properties(heaps: DataFrame) -> DataFrame:
    """Attribute record of each heap in use, values rounded to 3 decimals."""
    r3 = lambda n: F.round(n, 3).alias(n)
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    return heaps.where("not is_excluded").select(
        "survey_id", F.col("heap_id").alias("id"), text("label"),
        *[r3(n) for n in (
            "volume_m3", "planimetric_area_m2", "surface_area_m2", "max_height_m", "mean_height_m",
            "base_elevation_m", "centroid_e", "centroid_n",
        )],
        text("material_category"), r3("material_confidence"),
        F.col("is_manually_confirmed").cast("int").alias("is_manually_confirmed"),
        text("survey_date"),
        *(["rings"] if "rings" in heaps.columns else []),
    )


def features(heaps: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per heap in use."""
    rows = properties(heaps)
    names = [n for n in SHORT_NAMES if n in rows.columns]
    return rows.select(
        "survey_id", "id",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(*names).alias("properties"),
                F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("feature"),
    )


def write_geojson_lines(heaps: DataFrame, path: str) -> None:
    """Features as text lines, one folder per survey: no survey is gathered in one task."""
    features(heaps).select("survey_id", "feature").write.mode("overwrite").partitionBy("survey_id").text(path)


def short_attributes(heaps: DataFrame) -> DataFrame:
    """Attribute table with the ten-character names."""
    rows = properties(heaps)
    out = rows.select("survey_id", *[F.col(n).alias(s) for n, s in SHORT_NAMES.items() if n in rows.columns])
    long = [n for n in out.columns[1:] if len(n) > 10]
    if long:
        raise ValueError(f"attribute names over 10 characters: {long}")
    return out


def write_cells(cells: DataFrame, path: str) -> None:
    """Raster table partitioned by survey and clustered by grid line."""
    cells.repartition("survey_id", F.floor(F.col("r") / 256)).sortWithinPartitions("survey_id", "r", "c").write.mode(
        "overwrite"
    ).partitionBy("survey_id").parquet(path)


def nodata_view(cells: DataFrame) -> DataFrame:
    """Cells with the nodata value and single precision, for tools that expect them."""
    return cells.select("survey_id", "r", "c", F.coalesce("v", F.lit(NODATA)).cast("float").alias("v"))


def results_documents(metrics: DataFrame, summaries: DataFrame) -> DataFrame:
    """One results document per survey: metadata, heaps in id order, base elevation, files, warnings.

    The document of a survey is one JSON value; it holds heap records, never cells.
    """
    heap = F.struct("heap_id", *[c for c in metrics.columns if c not in ("survey_id", "heap_id")])
    packed = metrics.groupBy("survey_id").agg(F.array_sort(F.collect_list(heap)).alias("heap_metrics"))
    joined = summaries.join(packed, "survey_id", "left")
    empty = F.array().cast(packed.schema["heap_metrics"].dataType)
    fields = [c for c in summaries.columns if c != "survey_id"]
    return joined.select(
        "survey_id",
        F.to_json(F.struct(F.coalesce("heap_metrics", empty).alias("heap_metrics"), *fields)).alias("document"),
    )


def bulk_insert(metrics: DataFrame) -> DataFrame:
    """Heap rows of a new survey with the row defaults; heaps judged not to be heaps are excluded."""
    return metrics.select(
        "*",
        F.lit(False).alias("is_manually_confirmed"),
        F.coalesce(~F.col("is_heap"), F.lit(False)).alias("is_excluded"),
    ).drop("is_heap")


def replace_surveys(fresh: DataFrame, path: str) -> None:
    """Replacement of whole surveys in a partitioned table, each survey's folder at a time; readers may see some replaced before others."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").parquet(path)


def comparison_rows(summary: DataFrame) -> DataFrame:
    """Comparisons as stored rows: the result as JSON text."""
    keys = ["pair_id", "survey_a", "survey_b", "created_at"]
    return summary.select(*keys, F.to_json(F.struct(*[c for c in summary.columns if c not in keys])).alias("results"))


def comparisons_of(stored: DataFrame, survey_id: int) -> DataFrame:
    """Comparisons that involve a survey on either side, newest first."""
    return stored.where((F.col("survey_a") == survey_id) | (F.col("survey_b") == survey_id)).orderBy(
        F.desc("created_at"), F.desc("pair_id")
    )


def section_listing(sections: DataFrame) -> DataFrame:
    """Cross-section list without the heavy profile column."""
    return sections.drop("profile_json").orderBy(F.desc("created_at"), F.desc("section_id"))
