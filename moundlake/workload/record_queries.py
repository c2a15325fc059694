"""Queries over heap records, surveys, projects, documents and message logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from moundlake.functions import cells as cx
from moundlake.functions import formats
from moundlake.operators import compare, report, segments, zonal
from moundlake.operators.surface import bin_points
from moundlake.sinks import exports
from moundlake.sinks.versions import VersionedTables
from moundlake.sources import documents as sd
from moundlake.sources import folders as sf
from moundlake.sources import messages as sm
from moundlake.sources import points as sp
from moundlake.streaming import jobs
from moundlake.runtime import bounded_broadcast, ensure_checkpoint_dir
from moundlake.workload import adapter, stages
from moundlake.workload.adapter import heap_records, projects, surveys, table
from moundlake.workload.registry import register
from moundlake.workload.sqltext import query, step

step("heaps", (), """
SELECT o_orderkey AS heap_id, o_custkey % 25 AS survey_id, 'Cumulo ' || o_orderkey AS label,
  (cents % 1000003)/1000e0 AS volume_m3, (cents % 90001)/1000e0 AS planimetric_area_m2,
  (cents % 90001 + o_orderkey % 977)/1000e0 AS surface_area_m2, (cents % 1201)/100e0 AS max_height_m,
  (cents % 601)/100e0 AS mean_height_m, (10000 + o_custkey % 500)/100e0 AS base_elevation_m,
  500000e0 + (o_orderkey*7919 % 200000)/1000e0 AS centroid_e, 5000000e0 + (o_orderkey*104729 % 200000)/1000e0 AS centroid_n,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (['sabbia','ghiaia','argilla','scorie','carbone'])[o_orderkey % 7 % 5 + 1] END AS material_category,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 10)/10e0 END AS material_confidence,
  o_orderkey % 3 = 0 AS is_manually_confirmed, o_orderkey % 8 = 0 AS is_excluded,
  CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'vlm:base' END AS classified_by
FROM (SELECT *, CAST(round(o_totalprice*100e0) AS BIGINT) AS cents FROM orders)""")
step("surveys", (), """
SELECT n_nationkey AS survey_id, n_regionkey AS project_id, CAST(DATE '2025-01-01' + n_nationkey AS DATE) AS survey_date,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 100e0 + n_nationkey END AS base_elevation FROM nation""")


def dated(spark, d):
    """Heap records with the date of their survey."""
    return heap_records(spark, d).join(bounded_broadcast(surveys(spark, d).select("survey_id", "survey_date")), "survey_id")


# ---- filters and predicates ----------------------------------------------
@register("PRJ-11", query("SELECT survey_id, heap_id, volume_m3 FROM heaps WHERE NOT is_excluded", "heaps"))
def prj_11(spark, d):
    kept = report.exportable(heap_records(spark, d))
    return report.guard_not_empty(kept, "no heap to export").select("survey_id", "heap_id", "volume_m3")


@register("PRJ-12", query("SELECT survey_id, heap_id FROM heaps WHERE is_manually_confirmed OR material_category IS NOT NULL", "heaps"))
def prj_12(spark, d):
    return report.reportable(heap_records(spark, d)).select("survey_id", "heap_id")


@register("PRJ-13", query("""
SELECT survey_id, count(*) AS all_heaps, count(*) FILTER (NOT is_excluded) AS without_excluded,
  count(*) FILTER (is_manually_confirmed) AS confirmed_only, count(*) FILTER (NOT is_excluded AND is_manually_confirmed) AS both
FROM heaps GROUP BY 1""", "heaps"))
def prj_13(spark, d):
    return report.export_preview(heap_records(spark, d), ["survey_id"])


@register("PRJ-14", query("""
SELECT survey_id, heap_id, label, material_category FROM heaps
WHERE contains(lower(concat_ws(' ', label, material_category, '#' || heap_id)), 'a #12')""", "heaps"))
def prj_14(spark, d):
    return report.text_filter(heap_records(spark, d), "A #12").select("survey_id", "heap_id", "label", "material_category")


@register("PRJ-15", query("""
SELECT heap_id, planimetric_area_m2 < 0.5 AS too_small, planimetric_area_m2 > (heap_id % 120)/2e0 AND heap_id % 120 > 0 AS anomalous FROM heaps""", "heaps"))
def prj_15(spark, d):
    area = F.col("planimetric_area_m2")
    return heap_records(spark, d).select(
        "heap_id", report.too_small(area).alias("too_small"),
        report.anomalous(area, (F.col("heap_id") % 120).cast("double")).alias("anomalous"),
    )


INPUTS_SQL = """
SELECT o_orderkey AS survey_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'a.las' END AS las_path,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'a.tif' END AS tiff_path,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'EPSG:32633' ELSE 'EPSG:32632' END AS las_crs,
  CASE o_orderkey % 7 WHEN 0 THEN '' ELSE 'EPSG:32632' END AS tiff_crs,
  CAST(o_custkey % 300 AS DOUBLE) AS las_min_x, CAST(o_custkey % 300 + 100 AS DOUBLE) AS las_max_x,
  0e0 AS las_min_y, 100e0 AS las_max_y, 0e0 AS tiff_min_x, 200e0 AS tiff_max_x, 0e0 AS tiff_min_y, 100e0 AS tiff_max_y FROM orders"""


@register("PRJ-16", f"""
SELECT survey_id, concat_ws('; ',
  CASE WHEN las_path IS NULL THEN 'point cloud not found' END, CASE WHEN tiff_path IS NULL THEN 'orthophoto not found' END,
  CASE WHEN ok AND las_crs IS NULL THEN 'point cloud without CRS' END, CASE WHEN ok AND tiff_crs = '' THEN 'orthophoto without CRS' END,
  CASE WHEN ok AND las_crs IS NOT NULL AND tiff_crs <> '' AND las_crs <> tiff_crs THEN 'CRS mismatch: ' || las_crs || ' / ' || tiff_crs END,
  CASE WHEN ok AND las_min_x > tiff_max_x THEN 'no spatial overlap' END) AS errors
FROM (SELECT *, las_path IS NOT NULL AND tiff_path IS NOT NULL AS ok FROM ({INPUTS_SQL}))""")
def prj_16(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    inputs = table(spark, d, "orders").select(
        k.alias("survey_id"), F.when(k % 17 != 0, "a.las").alias("las_path"), F.when(k % 19 != 0, "a.tif").alias("tiff_path"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "EPSG:32633").otherwise("EPSG:32632").alias("las_crs"),
        F.when(k % 7 == 0, "").otherwise("EPSG:32632").alias("tiff_crs"),
        (c % 300).cast("double").alias("las_min_x"), (c % 300 + 100).cast("double").alias("las_max_x"),
        *[F.lit(v).alias(n) for n, v in (("las_min_y", 0.0), ("las_max_y", 100.0), ("tiff_min_x", 0.0),
                                         ("tiff_max_x", 200.0), ("tiff_min_y", 0.0), ("tiff_max_y", 100.0))],
    )
    return sd.input_errors(inputs).withColumn("errors", F.array_join("errors", "; "))


MESSAGES = ["Wrong magic bytes", "file too small", "CRS could not be read: not set", "no CRS in header", "disk on fire", "unknown crs"]


@register("PRJ-17", """
SELECT event_id, CASE WHEN kind IN (0, 1) OR event_id % 11 = 0 THEN 'CORRUPT_LAS' WHEN kind IN (2, 3) THEN 'MISSING_CRS'
    ELSE 'CORRUPT_LAS' END AS las_code, 'MISSING_CRS' AS tiff_code,
  CASE WHEN kind IN (2, 3, 5) THEN 'no valid CRS' ELSE 'invalid raster: ' || msg END AS tiff_detail
FROM (SELECT event_id, event_id % 6 AS kind, (['Wrong magic bytes','file too small','CRS could not be read: not set','no CRS in header','disk on fire','unknown crs'])[event_id % 6 + 1] AS msg FROM events)""")
def prj_17(spark, d):
    msg = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", msg.alias("msg"))
    tiff = sd.tiff_error_code(F.col("msg"))
    return rows.select(
        "event_id", sd.las_error_code(F.col("msg"), F.col("event_id") % 11 == 0).alias("las_code"),
        tiff["code"].alias("tiff_code"), tiff["detail"].alias("tiff_detail"),
    )


@register("PRJ-18", query("""
SELECT heap_id, coalesce(material_confidence < 0.7e0 AND classified_by <> 'manual', false) AS low_confidence FROM heaps""", "heaps"))
def prj_18(spark, d):
    return heap_records(spark, d).select(
        "heap_id", report.low_confidence(F.col("material_confidence"), F.col("classified_by")).alias("low_confidence")
    )


@register("PRJ-21", f"""
SELECT survey_id, coalesce(las_crs <> '' AND tiff_crs <> '' AND las_crs = tiff_crs, false) AS compatible FROM ({INPUTS_SQL})""")
def prj_21(spark, d):
    k = F.col("o_orderkey")
    las = F.when(k % 5 == 0, None).when(k % 5 == 1, "EPSG:32633").otherwise("EPSG:32632")
    tiff = F.when(k % 7 == 0, "").otherwise("EPSG:32632")
    return table(spark, d, "orders").select(k.alias("survey_id"), sp.crs_compatible(las, tiff).alias("compatible"))


@register("PRJ-22", query("""
SELECT heap_id, CASE WHEN abs(pct)/100 < 0.05 THEN 'unchanged' WHEN pct > 0 THEN 'grown' ELSE 'decreased' END AS state
FROM (SELECT heap_id, CASE WHEN volume_m3 > 0 THEN (heap_id % 41 - 20)/1e0/volume_m3*100 ELSE 0 END AS pct FROM heaps)""", "heaps"))
def prj_22(spark, d):
    delta = (F.col("heap_id") % 41 - 20).cast("double")
    percent = F.when(F.col("volume_m3") > 0, delta / F.col("volume_m3") * 100).otherwise(F.lit(0.0))
    return heap_records(spark, d).select("heap_id", compare.match_state(F.when(F.col("volume_m3") > 0, delta).otherwise(F.lit(0.0)), percent).alias("state"))


@register("PRJ-26", query("""
SELECT s.survey_id, coalesce(s.base_elevation, (SELECT base_elevation_m FROM heaps h WHERE h.survey_id = s.survey_id ORDER BY heap_id LIMIT 1), 0e0) AS base,
  coalesce((SELECT base_elevation_m FROM heaps h WHERE h.survey_id = s.survey_id ORDER BY heap_id LIMIT 1), 0e0) AS editing_base
FROM surveys s""", "heaps", "surveys"))
def prj_26(spark, d):
    heaps = heap_records(spark, d).withColumnRenamed("base_elevation_m", "base_elevation")
    s = surveys(spark, d)
    editing = zonal.base_provenance(s, heaps, use_survey_value=False).withColumnRenamed("base", "editing_base")
    return zonal.base_provenance(s, heaps).join(editing, "survey_id")


# ---- joins ---------------------------------------------------------------
@register("JON-07", query("""
SELECT survey_id, heap_id, coalesce(nullif(CASE WHEN heap_id % 3 = 0 THEN 0 WHEN heap_id % 3 = 1 THEN NULL ELSE volume_m3 + 1 END, 0),
  nullif(CASE WHEN heap_id % 4 = 0 THEN NULL ELSE volume_m3 END, 0), 0) AS volume_m3 FROM heaps""", "heaps"))
def jon_07(spark, d):
    """Edited volumes over measured ones; zero and missing fall through."""
    heaps = heap_records(spark, d)
    k = F.col("heap_id") % 3
    edited = heaps.select(
        "survey_id", "heap_id", F.when(k == 0, 0.0).when(k == 1, None).otherwise(F.col("volume_m3") + 1).alias("volume_m3")
    )
    measured = heaps.where("heap_id % 4 <> 0").select("survey_id", "heap_id", "volume_m3")
    return report.enrich(edited, measured, ["volume_m3"])


@register("JON-08", query("""
SELECT survey_id, heap_id, CASE WHEN heap_id % 2 = 0 THEN material_category END AS material_category,
  heap_id % 2 = 0 AND is_manually_confirmed AS is_manually_confirmed FROM heaps""", "heaps"))
def jon_08(spark, d):
    heaps = heap_records(spark, d)
    classes = heaps.where("heap_id % 2 = 0").select("survey_id", "heap_id", "material_category", "is_manually_confirmed")
    return report.with_classification(heaps.select("survey_id", "heap_id"), classes)


@register("JON-11", query("""
SELECT heap_id, CASE material_category WHEN 'sabbia' THEN '#ef4444' WHEN 'ghiaia' THEN '#f97316' WHEN 'argilla' THEN '#f59e0b'
  WHEN 'scorie' THEN '#eab308' WHEN 'carbone' THEN '#84cc16' ELSE '#6b7280' END AS colour FROM heaps""", "heaps"))
def jon_11(spark, d):
    heaps = heap_records(spark, d).join(bounded_broadcast(surveys(spark, d).select("survey_id", "project_id")), "survey_id")
    return formats.category_colours(heaps, projects(spark, d)).select("heap_id", "colour")


@register("JON-12", query("""
SELECT p.r_regionkey AS project_id, count(DISTINCT s.survey_id) AS surveys, count(h.heap_id) AS heaps
FROM region p JOIN surveys s ON s.project_id = p.r_regionkey JOIN heaps h USING (survey_id) WHERE p.r_regionkey <> 2 GROUP BY 1""", "heaps", "surveys"))
def jon_12(spark, d):
    """Hierarchy counts after deleting project 2 with everything below it."""
    p = projects(spark, d)
    kp, ks, kh = report.cascade_delete(p, surveys(spark, d), heap_records(spark, d), p.where("project_id = 2"))
    per_survey = kh.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n"))
    return kp.join(ks, "project_id").join(per_survey, "survey_id").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("surveys"), F.sum("n").alias("heaps")
    )


@register("JON-13", query("""
SELECT survey_id, heap_id, arg_min(ref_id, struct_pack(d2 := d2, ref_id := ref_id)) AS ref_id, round(sqrt(min(d2)), 6) AS distance_m FROM (
  SELECT h.survey_id, heap_id, ref_id, (centroid_e - ref_e)*(centroid_e - ref_e) + (centroid_n - ref_n)*(centroid_n - ref_n) AS d2
  FROM heaps h CROSS JOIN (VALUES (1, 500050e0, 5000050e0), (2, 500150e0, 5000050e0), (3, 500050e0, 5000150e0), (4, 500150e0, 5000150e0)) t(ref_id, ref_e, ref_n))
GROUP BY 1, 2""", "heaps"))
def jon_13(spark, d):
    """Each heap with the nearest of the four known solids."""
    refs = F.array(*[F.struct(F.lit(i).alias("ref_id"), F.lit(e).alias("ref_e"), F.lit(n).alias("ref_n")) for i, e, n in (
        (1, 500050.0, 5000050.0), (2, 500150.0, 5000050.0), (3, 500050.0, 5000150.0), (4, 500150.0, 5000150.0))])
    references = surveys(spark, d).select("survey_id", F.explode(refs).alias("k")).select("survey_id", "k.*")
    return report.nearest_reference(heap_records(spark, d), references)


STATES_SQL = "(['unchanged','grown','decreased','added','removed','ambiguous'])[heap_id % 6 + 1]"


@register("JON-15", query(f"""
SELECT heap_id, state, CASE state WHEN 'unchanged' THEN 'Invariato' WHEN 'grown' THEN 'Cresciuto' WHEN 'decreased' THEN 'Diminuito'
  WHEN 'added' THEN 'Nuovo' WHEN 'removed' THEN 'Rimosso' ELSE 'Ambiguo' END AS state_label,
  CASE state WHEN 'unchanged' THEN '#9ca3af' WHEN 'grown' THEN '#ef4444' WHEN 'decreased' THEN '#3b82f6'
  WHEN 'added' THEN '#22c55e' WHEN 'removed' THEN '#4b5563' ELSE '#f97316' END AS state_colour
FROM (SELECT heap_id, {STATES_SQL} AS state FROM heaps)""", "heaps"))
def jon_15(spark, d):
    names = F.array(*[F.lit(s) for s in formats.STATE_LABELS])
    rows = heap_records(spark, d).select("heap_id", F.element_at(names, (F.col("heap_id") % 6 + 1).cast("int")).alias("state"))
    return formats.state_labels(rows)


# ---- aggregates ----------------------------------------------------------
@register("AGG-19", query("""
SELECT survey_id, count(*) AS heap_count, round(sum(volume_m3), 3) AS total_volume_m3, round(sum(planimetric_area_m2), 3) AS total_area_m2,
  round(avg(mean_height_m), 6) AS mean_height_m FROM heaps GROUP BY 1""", "heaps"))
def agg_19(spark, d):
    return report.site_summary(heap_records(spark, d), ["survey_id"])


@register("AGG-20", query("""
SELECT survey_id, round(sum(volume_m3), 3) AS total_volume_m3, round(avg(volume_m3), 6) AS average_volume_m3,
  arg_max(heap_id, struct_pack(v := volume_m3, h := heap_id)) AS largest_heap_id, max(volume_m3) AS largest_volume_m3 FROM heaps GROUP BY 1""", "heaps"))
def agg_20(spark, d):
    return report.survey_summary(heap_records(spark, d))


@register("AGG-21", query("""
SELECT survey_id, material_category, round(volume, 3) AS volume_m3, round(share, 6) AS share_percent,
  CASE WHEN share > 3 THEN printf('%.1f%%', share) ELSE '' END AS share_label
FROM (SELECT *, volume/sum(volume) OVER (PARTITION BY survey_id)*100 AS share FROM (
  SELECT survey_id, material_category, sum(volume_m3) AS volume FROM heaps GROUP BY 1, 2))""", "heaps"))
def agg_21(spark, d):
    return report.category_volumes(heap_records(spark, d), ["survey_id"])


@register("AGG-22", query("""
SELECT survey_id, CAST(bin AS INT) AS bin, round(lo + bin*w, 6) AS bin_from, round(lo + (bin + 1)*w, 6) AS bin_to,
  (SELECT count(*) FROM heaps h WHERE h.survey_id = b.survey_id AND volume_m3 > 0 AND least(floor((volume_m3 - lo)/w), bins - 1) = bin) AS heaps
FROM (SELECT *, (hi - lo)/bins AS w, unnest(range(bins)) AS bin FROM (
  SELECT survey_id, min(volume_m3) AS lo, max(volume_m3) AS hi, least(10, greatest(3, count(*)//2)) AS bins FROM heaps WHERE volume_m3 > 0 GROUP BY 1)) b""", "heaps"))
def agg_22(spark, d):
    return report.volume_histogram(heap_records(spark, d), ["survey_id"])


@register("AGG-24", query("""
SELECT survey_id, round(sum(planimetric_area_m2), 3) AS area_m2, round(-0.35e0*sum(planimetric_area_m2), 5) AS delta_volume_m3
FROM heaps WHERE NOT is_excluded GROUP BY 1""", "heaps"))
def agg_24(spark, d):
    out = zonal.volume_shift_preview(heap_records(spark, d), F.lit(0.35))
    return out.select("survey_id", F.round("area_m2", 3).alias("area_m2"), F.round("delta_volume_m3", 5).alias("delta_volume_m3"))


@register("AGG-25", query("""
SELECT survey_id, survey_id % 2 = 0 AS needs_repair, round(x1, 3) AS min_x, round(x2 + CASE WHEN survey_id % 2 = 0 THEN 0e0 ELSE 5e-5 END, 3) AS max_x, z1 AS min_z, z2 AS max_z
FROM (SELECT survey_id, min(500000e0 + (u + 0.5e0)*0.05e0) AS x1, max(500000e0 + (u + 0.5e0)*0.05e0) AS x2, min(z_mm/1000e0) AS z1, max(z_mm/1000e0) AS z2 FROM pts GROUP BY 1)""", "pts"))
def agg_25(spark, d):
    """Even surveys carry a header 2 m off, odd ones differ below the tolerance."""
    meta = sp.metadata(adapter.points(spark, d))
    off = F.when(F.col("survey_id") % 2 == 0, F.lit(2.0)).otherwise(F.lit(5e-5))
    headers = meta.withColumn("max_x", F.col("max_x") + off)
    return sp.bounds_audit(meta, headers).select(
        "survey_id", "needs_repair", F.round("min_x", 3).alias("min_x"), F.round("max_x", 3).alias("max_x"), "min_z", "max_z"
    )


@register("AGG-29", query("""
SELECT survey_id, min(volume_m3) > 0 AND min(planimetric_area_m2) > 0 AND min(max_height_m) > 0 AS all_positive, max(volume_m3) < 1e8 AS volumes_bounded,
  max(planimetric_area_m2) < 0.3*any_value(w*h*res*res) AS no_spanning_heap, sum(volume_m3) > 0 AND max(volume_m3)/sum(volume_m3) < 0.6 AS no_dominating_heap
FROM metrics JOIN grid USING (survey_id) GROUP BY 1""", "metrics", "grid"))
def agg_29(spark, d):
    g = stages.grids(spark, d)
    area = g.select("survey_id", (F.col("width") * F.col("height") * F.col("res") * F.col("res")).alias("site_area_m2"))
    return report.run_checks(stages.metrics(spark, d), area)


@register("WIN-13", query("""
SELECT survey_id, heap_id, round(volume_m3/sum(volume_m3) OVER (PARTITION BY survey_id), 9) AS volume_share FROM heaps""", "heaps"))
def win_13(spark, d):
    return report.shares(heap_records(spark, d), ["survey_id"]).select("survey_id", "heap_id", "volume_share")


@register("SPC-03", query("""
SELECT survey_id, category, round(volume_m3, 3) AS volume_m3, round(sum(volume_m3) OVER (PARTITION BY survey_id), 3) AS total_m3
FROM (SELECT survey_id, coalesce(material_category, 'unclassified') AS category, sum(volume_m3) AS volume_m3 FROM heaps GROUP BY ALL)""", "heaps"))
def spc_03(spark, d):
    """Volumes of each survey stacked by category."""
    stacked = report.stacked_volumes(heap_records(spark, d))
    return stacked.select("survey_id", "category", *[F.round(c, 3).alias(c) for c in ("volume_m3", "total_m3")])


@register("SPC-05", query("""
SELECT survey_id, heap_id, CASE WHEN heap_id % 6 = 0 THEN 'ferro' WHEN heap_id % 4 = 0 THEN NULL ELSE 'tornitura' END AS material_category,
  CASE WHEN heap_id % 6 = 0 OR heap_id % 4 = 0 THEN NULL ELSE (heap_id % 10)/10e0 END AS material_confidence,
  heap_id % 6 <> 0 AND heap_id % 4 <> 0 AND (heap_id % 10)/10e0 < 0.7e0 AS low_confidence, heap_id % 6 = 0 AS is_manual FROM heaps""", "heaps"))
def spc_05(spark, d):
    """Model results as JSON text; a category set by hand wins."""
    heaps = heap_records(spark, d).select("survey_id", "heap_id", F.when(F.col("heap_id") % 6 == 0, "ferro").alias("manual_category"))
    results = heaps.where("heap_id % 4 <> 0").select(
        "survey_id", "heap_id",
        F.format_string('{"category": "tornitura", "confidence": %.1f}', (F.col("heap_id") % 10) / 10.0).alias("result"),
    )
    return report.classification_ingest(heaps, results)


# ---- orders --------------------------------------------------------------
ORDER_BY = {
    "id": "heap_id", "volume": "volume_m3 DESC, heap_id", "area": "planimetric_area_m2 DESC, heap_id",
    "height": "max_height_m DESC, heap_id", "category": "coalesce(material_category, 'zzz'), heap_id",
}
for _key, _order in ORDER_BY.items():
    def _sorted(spark, d, key=_key):
        return report.heap_order(heap_records(spark, d), key).select(
            "heap_id", "volume_m3", "planimetric_area_m2", "max_height_m", "material_category"
        )

    register(f"SRT-01-{_key}", query(
        f"SELECT heap_id, volume_m3, planimetric_area_m2, max_height_m, material_category FROM heaps ORDER BY {_order}", "heaps"
    ))(_sorted)


@register("SRT-02", query("SELECT survey_id, project_id, survey_date FROM surveys ORDER BY survey_date DESC, survey_id", "surveys"))
def srt_02(spark, d):
    return surveys(spark, d).select("survey_id", "project_id", "survey_date").orderBy(F.desc("survey_date"), "survey_id")


@register("SRT-03", query("""
SELECT survey_id, material_category, round(sum(volume_m3), 3) AS volume_m3 FROM heaps GROUP BY 1, 2 ORDER BY survey_id, volume_m3 DESC""", "heaps"))
def srt_03(spark, d):
    return report.category_volumes(heap_records(spark, d), ["survey_id"]).select(
        "survey_id", "material_category", "volume_m3"
    ).orderBy("survey_id", F.desc("volume_m3"))


@register("SRT-04", query("""
SELECT survey_id, heap_id, planimetric_area_m2, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY planimetric_area_m2 DESC, heap_id) AS rank FROM heaps) WHERE rank <= 5""", "heaps"))
def srt_04(spark, d):
    return report.top_heaps(heap_records(spark, d), "planimetric_area_m2", 5).select(
        "survey_id", "heap_id", "planimetric_area_m2", "rank"
    )


@register("SET-04", query("""
SELECT heap_id, label, volume_m3 FROM heaps WHERE heap_id % 10 <> 0
UNION ALL SELECT heap_id, label || ' (restored)', volume_m3 FROM heaps WHERE heap_id % 20 = 0""", "heaps"))
def set_04(spark, d):
    """Undo: every tenth heap is deleted, every twentieth comes back from the snapshot."""
    heaps = heap_records(spark, d).select("heap_id", "label", "volume_m3")
    snapshot = heaps.where("heap_id % 20 = 0").withColumn("label", F.concat("label", F.lit(" (restored)")))
    return report.restore_snapshot(heaps, heaps.where("heap_id % 10 = 0").select("heap_id"), snapshot)


@register("WIN-10", query("""
SELECT h.survey_id, heap_id, CAST(part AS INT) AS part, label || ' (' || part || '/' || (2 + heap_id % 2) || ')' AS label,
  'Cumulo ' || n AS next_label, 'Cumuli uniti (' || (2 + heap_id % 2) || ')' AS merged_label
FROM (SELECT *, unnest(range(1, CAST(3 + heap_id % 2 AS INT))) AS part FROM heaps) h JOIN (SELECT survey_id, count(*) + 1 AS n FROM heaps GROUP BY 1) USING (survey_id)""", "heaps"))
def win_10(spark, d):
    """Labels of split parts, of the next heap and of merged heaps."""
    heaps = heap_records(spark, d).select("survey_id", "heap_id", "label")
    members = (F.col("heap_id") % 2 + 2).cast("int")
    parts = heaps.select("*", members.alias("members"), F.explode(F.sequence(F.lit(1), members)).alias("part"))
    merged = report.merged_labels(heaps.select("heap_id", members.alias("members"))).select("heap_id", F.col("label").alias("merged_label"))
    return report.part_labels(parts).drop("members").join(
        bounded_broadcast(report.next_labels(heaps).select("survey_id", "next_label")), "survey_id"
    ).join(merged, "heap_id")


# ---- sinks ---------------------------------------------------------------
@register("SNK-01", query("""
SELECT CAST(heap_id AS VARCHAR) AS "ID", printf('%.3f', volume_m3) AS "Volume_m3", printf('%.3f', planimetric_area_m2) AS "Area_planimetrica_m2",
  printf('%.3f', surface_area_m2) AS "Area_superficiale_m2", printf('%.2f', max_height_m) AS "Altezza_max_m", printf('%.2f', mean_height_m) AS "Altezza_media_m",
  printf('%.2f', base_elevation_m) AS "Quota_base_mslm", printf('%.6f', centroid_e) AS "Centroide_E", printf('%.6f', centroid_n) AS "Centroide_N",
  printf('%.6f', centroid_e - 1) AS "BBox_minE", printf('%.6f', centroid_n - 1) AS "BBox_minN", printf('%.6f', centroid_e + 1) AS "BBox_maxE", printf('%.6f', centroid_n + 1) AS "BBox_maxN",
  coalesce(material_category, '') AS "Categoria_materiale", CAST(survey_date AS VARCHAR) AS "Data_rilievo"
FROM heaps JOIN surveys USING (survey_id)""", "heaps", "surveys"))
def snk_01(spark, d):
    e, n = F.col("centroid_e"), F.col("centroid_n")
    heaps = dated(spark, d).select(
        "*", (e - 1).alias("bbox_min_e"), (n - 1).alias("bbox_min_n"), (e + 1).alias("bbox_max_e"), (n + 1).alias("bbox_max_n")
    )
    return exports.csv_rows(heaps)


@register("SNK-02", query("""
SELECT survey_id, heap_id AS id, volume_m3, coalesce(material_category, '') AS material_category, material_confidence,
  CAST(is_manually_confirmed AS INT) AS is_manually_confirmed, CAST(survey_date AS VARCHAR) AS survey_date, 'Polygon' AS geometry_type, centroid_e AS first_x
FROM heaps JOIN surveys USING (survey_id) WHERE NOT is_excluded""", "heaps", "surveys"))
def snk_02(spark, d):
    """Features written as GeoJSON text and read back."""
    e, n = F.col("centroid_e"), F.col("centroid_n")
    ring = F.array(*[F.array(e + dx, n + dy) for dx, dy in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])
    text = exports.features(dated(spark, d).withColumn("rings", F.array(ring)))
    props = "id long, volume_m3 double, material_category string, material_confidence double, is_manually_confirmed int, survey_date string"
    back = text.select("survey_id", F.from_json("feature", f"properties struct<{props.replace(' ', ':').replace(',:', ',')}>, geometry struct<type:string,coordinates:array<array<array<double>>>>").alias("f"))
    return back.select(
        "survey_id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates")[0][0][0].alias("first_x")
    )


@register("SNK-03", query("""
SELECT survey_id, heap_id AS id, label, volume_m3 AS vol_m3, planimetric_area_m2 AS area_pl_m2, surface_area_m2 AS area_sf_m2, max_height_m AS h_max_m,
  mean_height_m AS h_mean_m, base_elevation_m AS base_m, centroid_e AS centr_e, centroid_n AS centr_n, coalesce(material_category, '') AS mat_cat,
  material_confidence AS mat_conf, CAST(is_manually_confirmed AS INT) AS confirmed, CAST(survey_date AS VARCHAR) AS surv_date
FROM heaps JOIN surveys USING (survey_id) WHERE NOT is_excluded""", "heaps", "surveys"))
def snk_03(spark, d):
    return exports.short_attributes(dated(spark, d))


DOC_SQL = """
SELECT survey_id, count(*) AS heaps, round(sum(volume_m3), 3) AS total_volume_m3, min(heap_id) AS first_heap, 100e0 AS base_elevation, 'manual' AS base_elevation_method
FROM heaps GROUP BY 1"""


def _documents(spark, d):
    heaps = heap_records(spark, d).select("survey_id", "heap_id", "volume_m3", "planimetric_area_m2", "max_height_m")
    summaries = surveys(spark, d).select(
        "survey_id", F.create_map(F.lit("crs"), F.lit("EPSG:32632")).alias("survey_metadata"), F.lit(100.0).alias("base_elevation"),
        F.lit("manual").alias("base_elevation_method"), F.array(F.lit("checked")).alias("warnings"),
    )
    return exports.results_documents(heaps, summaries)


@register("SNK-04", query(DOC_SQL, "heaps"))
def snk_04(spark, d):
    """Results documents, described from their JSON text."""
    doc = sd.parse_results(_documents(spark, d))
    total = F.aggregate("heap_metrics", F.lit(0.0), lambda acc, h: acc + h["volume_m3"])
    return doc.select(
        "survey_id", F.size("heap_metrics").cast("long").alias("heaps"), F.round(total, 3).alias("total_volume_m3"),
        F.col("heap_metrics")[0]["heap_id"].alias("first_heap"), "base_elevation", "base_elevation_method",
    )


@register("SRC-14", query("SELECT survey_id, heap_id, volume_m3, planimetric_area_m2, max_height_m FROM heaps", "heaps"))
def src_14(spark, d):
    """Heap rows read back from results documents."""
    return sd.result_heaps(sd.parse_results(_documents(spark, d))).select(
        "survey_id", "heap_id", "volume_m3", "planimetric_area_m2", "max_height_m"
    )


@register("SNK-05", query("""
SELECT survey_id, r, c, CAST(coalesce(v, -9999e0) AS FLOAT) AS v FROM cell LEFT JOIN dsm_raw USING (survey_id, r, c)""", "cell", "dsm_raw"))
def snk_05(spark, d):
    from moundlake.operators.neighbourhood import dense_cells

    return exports.nodata_view(dense_cells(stages.surface_raw(spark, d), stages.grids(spark, d)))


@register("SNK-06", query("""
SELECT survey_id, heap_id, false AS is_manually_confirmed, heap_id % 4 = 0 AS is_excluded FROM heaps""", "heaps"))
def snk_06(spark, d):
    judged = heap_records(spark, d).select(
        "survey_id", "heap_id", F.when(F.col("heap_id") % 4 == 0, False).when(F.col("heap_id") % 4 == 1, True).alias("is_heap")
    )
    return exports.bulk_insert(judged)


@register("SNK-07", query("""
SELECT h.survey_id, heap_id, CASE WHEN h.survey_id % 5 = 0 THEN round(greatest(volume_m3 - 0.25e0*planimetric_area_m2, 0e0), 6) ELSE volume_m3 END AS volume_m3,
  CASE WHEN h.survey_id % 5 = 0 THEN 100.25e0 ELSE 100e0 END AS base FROM heaps h""", "heaps"))
def snk_07(spark, d):
    """Every fifth survey gets a new base elevation: its heaps and its base are replaced in one commit."""
    ensure_checkpoint_dir(spark)
    tables = VersionedTables(spark, f"{spark.sparkContext.getCheckpointDir()}/bases-{uuid.uuid4().hex}")
    heaps = heap_records(spark, d).select("survey_id", F.lit(0).alias("part"), "heap_id", "volume_m3", "planimetric_area_m2")
    bases = heaps.select("survey_id", "part").distinct().withColumn("base", F.lit(100.0))
    tables.commit({"heaps": heaps, "surveys": bases})
    chosen = bases.where("survey_id % 5 = 0").select("survey_id", F.lit(100.25).alias("base"))
    report.replace_bases(tables, chosen)
    return tables.read("heaps").join(tables.read("surveys"), ["survey_id", "part"]).select("survey_id", "heap_id", "volume_m3", "base")


@register("SNK-08", query("""
SELECT heap_id AS pair_id, survey_id AS survey_a, heap_id % 25 AS survey_b, heap_id % 7 AS grown, heap_id % 3 AS removed
FROM heaps WHERE survey_id = 3 OR heap_id % 25 = 3 ORDER BY heap_id DESC""", "heaps"))
def snk_08(spark, d):
    """Stored comparisons (one per heap record) that involve survey 3, newest first."""
    summary = heap_records(spark, d).select(
        F.col("heap_id").alias("pair_id"), F.col("survey_id").alias("survey_a"), (F.col("heap_id") % 25).alias("survey_b"),
        F.expr("timestamp_seconds(1735689600 + heap_id)").alias("created_at"),
        (F.col("heap_id") % 7).alias("grown"), (F.col("heap_id") % 3).alias("removed"),
    )
    found = exports.comparisons_of(exports.comparison_rows(summary), 3)
    return found.select("pair_id", "survey_a", "survey_b", F.from_json("results", "grown long, removed long").alias("k")).select(
        "pair_id", "survey_a", "survey_b", "k.*"
    )


@register("SNK-09", query("SELECT heap_id AS section_id, survey_id, 'Sezione ' || heap_id AS label FROM heaps ORDER BY heap_id DESC", "heaps"))
def snk_09(spark, d):
    sections = heap_records(spark, d).select(
        F.col("heap_id").alias("section_id"), "survey_id", F.concat(F.lit("Sezione "), F.col("heap_id")).alias("label"),
        F.to_json(F.struct("volume_m3", "max_height_m")).alias("profile_json"), F.expr("timestamp_seconds(1735689600 + heap_id)").alias("created_at"),
    )
    return exports.section_listing(sections).drop("created_at")


# ---- folders, configurations, lines --------------------------------------
LISTING_SQL = """
SELECT 'job' || o_orderkey AS folder, rel AS relpath, epoch_ms(1735689600000 + (o_orderkey*7 + k*5)*3600000) AS mtime, o_orderkey, k
FROM orders CROSS JOIN (VALUES (0, 'map/dsm.tif', 3), (1, 'models/pc/0/terra_dem/dem.tif', 4), (2, 'map/result.tif', 11),
  (3, 'models/pc/0/terra_las/cloud_merged.las', 13), (4, 'map/2dPipeline_done', 5)) t(k, rel, every) WHERE o_orderkey % every <> 1"""


def listing(spark, d):
    assets = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(rel).alias("relpath"), F.lit(every).alias("every"))
        for k, (rel, every) in enumerate((
            (sf.DSM_PRIMARY, 3), (sf.DSM_FALLBACK, 4), (sf.ORTHO, 11), (sf.CLOUD, 13), (sf.SENTINEL, 5)))
    ])
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(assets).alias("a")).select("o_orderkey", "a.*")
    return rows.where("o_orderkey % every <> 1").select(
        F.concat(F.lit("job"), F.col("o_orderkey")).alias("folder"), "relpath",
        F.expr("timestamp_seconds(1735689600 + (o_orderkey*7 + k*5)*3600)").alias("mtime"), F.lit(1).cast("long").alias("size"), "o_orderkey",
    )


SCAN_SQL = f"""
SELECT folder, CASE WHEN dsm THEN 'map/dsm.tif' WHEN dem THEN 'models/pc/0/terra_dem/dem.tif' END AS dsm_path,
  CASE WHEN ortho THEN 'map/result.tif' END AS orthophoto_path, CASE WHEN cloud THEN 'models/pc/0/terra_las/cloud_merged.las' END AS las_path,
  done AS pipeline_complete, CAST(least(CASE WHEN dsm THEN t0 ELSE t1 END, t2, t3) AS DATE) AS survey_date,
  concat_ws('; ', CASE WHEN NOT dsm AND dem THEN 'preferred DSM missing, fallback used' END, CASE WHEN NOT done THEN 'completion marker missing' END) AS warnings,
  CASE WHEN NOT dsm AND NOT dem THEN 'DSM not found' WHEN NOT ortho THEN 'orthophoto not found' WHEN NOT cloud THEN 'point cloud not found' END AS error
FROM (SELECT folder, bool_or(k = 0) AS dsm, bool_or(k = 1) AS dem, bool_or(k = 2) AS ortho, bool_or(k = 3) AS cloud, bool_or(k = 4) AS done,
  min(mtime) FILTER (k = 0) AS t0, min(mtime) FILTER (k = 1) AS t1, min(mtime) FILTER (k = 2) AS t2, min(mtime) FILTER (k = 3) AS t3
  FROM ({LISTING_SQL}) GROUP BY 1)"""


@register("SRC-10", SCAN_SQL)
def src_10(spark, d):
    return sf.scan_folders(listing(spark, d)).withColumn("warnings", F.array_join("warnings", "; "))


@register("SRC-13", f"SELECT folder, survey_date FROM ({SCAN_SQL})")
def src_13(spark, d):
    return sf.scan_folders(listing(spark, d)).select("folder", "survey_date")


@register("SRC-11", """
SELECT o_orderkey AS folder, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'EPSG:32632' WHEN o_orderkey % 4 = 1 THEN NULL END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'EPSG:32633' END, CASE WHEN o_orderkey % 5 = 0 THEN 'EPSG:4326' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'EPSG:3003' END) AS crs FROM orders""")
def src_11(spark, d):
    k = F.col("o_orderkey")
    crs = sf.resolve_crs(
        F.when(k % 4 == 0, "EPSG:32632").when(k % 4 == 2, ""), F.when(k % 3 == 0, "EPSG:32633"),
        F.when(k % 5 == 0, "EPSG:4326"), F.when(k % 7 == 0, "EPSG:3003"),
    )
    return table(spark, d, "orders").select(k.alias("folder"), crs.alias("crs"))


@register("SRC-15", """
SELECT o_orderkey AS survey_id, CASE WHEN o_orderkey % 6 >= 3 THEN NULL WHEN o_orderkey % 6 = 0 THEN 0.5e0 ELSE (o_orderkey % 9)/10e0 END AS height_threshold,
  CASE WHEN o_orderkey % 6 >= 3 THEN NULL WHEN o_orderkey % 6 = 1 THEN 25 ELSE 50 END AS morpho_kernel_size,
  CASE WHEN o_orderkey % 6 >= 3 THEN NULL ELSE true END AS use_ground_classification,
  CASE o_orderkey % 6 WHEN 3 THEN 'invalid JSON configuration' WHEN 4 THEN 'wrong type: height_threshold' WHEN 5 THEN 'wrong type: morpho_kernel_size' END AS error
FROM orders""")
def src_15(spark, d):
    """Inline configurations: empty, partial, with unknown keys, broken, of wrong types."""
    k = F.col("o_orderkey") % 6
    t = F.format_string("%.1f", (F.col("o_orderkey") % 9) / 10.0)
    text = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.concat(F.lit('{"height_threshold": '), t, F.lit(', "morpho_kernel_size": 25}')))
        .when(k == 2, F.concat(F.lit('{"height_threshold": '), t, F.lit(', "base_mode": "auto"}')))
        .when(k == 3, F.lit('{"height_threshold": '))
        .when(k == 4, F.concat(F.lit('{"height_threshold": "'), t, F.lit('"}')))
        .otherwise(F.lit('{"morpho_kernel_size": 2.5, "height_threshold": 1}'))
    )
    return sd.parse_config(table(spark, d, "orders").select(F.col("o_orderkey").alias("survey_id"), text.alias("config"))).select(
        "survey_id", "height_threshold", "morpho_kernel_size", "use_ground_classification", "error"
    )


@register("SRC-16", """
SELECT o_orderkey AS section_id, 2 AS points, (o_orderkey % 1000)/10e0 AS x1, (o_custkey % 1000)/10e0 AS y1, 1.5e0 AS x2, 2.5e0 AS y2 FROM orders""")
def src_16(spark, d):
    """Section lines in the three accepted notations."""
    x, y = F.format_string("%.1f", (F.col("o_orderkey") % 1000) / 10.0), F.format_string("%.1f", (F.col("o_custkey") % 1000) / 10.0)
    k = F.col("o_orderkey") % 3
    text = (
        F.when(k == 0, F.concat(F.lit('{"type":"LineString","coordinates":[['), x, F.lit(","), y, F.lit("],[1.5,2.5]]}")))
        .when(k == 1, F.concat(F.lit(" [["), x, F.lit(", "), y, F.lit("], [1.5, 2.5]]")))
        .otherwise(F.concat(x, F.lit(", "), y, F.lit("; 1.5,2.5")))
    )
    line = sd.parse_line(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("section_id"), line.alias("l")).select(
        "section_id", F.size("l").alias("points"), F.col("l")[0][0].alias("x1"), F.col("l")[0][1].alias("y1"),
        F.col("l")[1][0].alias("x2"), F.col("l")[1][1].alias("y2"),
    )


# ---- message log ---------------------------------------------------------
step("msg", (), """
SELECT event_id, user_id AS run_id, ts, event_id % 13 AS bad, CAST(value*100 AS BIGINT) % 101 AS percent,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'result' ELSE 'progress' END AS kind FROM events""")
MSG_SQL = """
SELECT event_id, run_id, CASE WHEN bad IN (1, 2, 3) THEN 'warning' ELSE kind END AS type,
  CASE WHEN bad NOT IN (1, 2, 3) THEN CAST(percent AS DOUBLE) END AS percent,
  CASE bad WHEN 1 THEN 'Non-JSON line: oops ' || event_id WHEN 2 THEN 'Line without type: {"percent": ' || percent || '}'
    WHEN 3 THEN 'Unknown type ''debug'': {"type": "debug", "percent": ' || percent || '}' ELSE 'm' || event_id END AS message
FROM msg WHERE bad <> 4"""


def log_lines(spark, d):
    """Message lines from events: well-formed, broken, without type, of unknown type, blank, with a BOM."""
    kind = F.expr("case event_type when 'error' then 'error' when 'signup' then 'warning' when 'purchase' then 'result' else 'progress' end")
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("run_id"), "ts", (F.col("event_id") % 13).alias("bad"),
        F.expr("cast(value*100 as decimal(20,0))").cast("long").alias("_p"), kind.alias("kind"),
    ).withColumn("percent", F.col("_p") % 101)
    good = F.concat(
        F.when(F.col("bad") == 5, F.lit("﻿")).otherwise(F.lit("")),
        F.lit('{"type": "'), F.col("kind"), F.lit('", "percent": '), F.col("percent"), F.lit(', "message": "m'), F.col("event_id"), F.lit('"}'),
    )
    text = (
        F.when(F.col("bad") == 1, F.concat(F.lit("oops "), F.col("event_id")))
        .when(F.col("bad") == 2, F.concat(F.lit('{"percent": '), F.col("percent"), F.lit("}")))
        .when(F.col("bad") == 3, F.concat(F.lit('{"type": "debug", "percent": '), F.col("percent"), F.lit("}")))
        .when(F.col("bad") == 4, F.lit("   "))
        .otherwise(good)
    )
    return rows.select("event_id", "run_id", "ts", text.alias("value"))


@register("SRC-17", query(MSG_SQL, "msg"))
def src_17(spark, d):
    return sm.parse_messages(log_lines(spark, d)).select("event_id", "run_id", "type", "percent", "message")


def _progress(spark, d):
    return sm.parse_messages(log_lines(spark, d)).where("type = 'progress'").withColumnRenamed("event_id", "seq")


step("prog", ("msg",), "SELECT * FROM msg WHERE bad NOT IN (1, 2, 3, 4) AND kind = 'progress'")


@register("WIN-11", query("""
SELECT run_id, phase, started, round(epoch_us(coalesce(lead(started) OVER w, max(last) OVER (PARTITION BY run_id)))/1e6 - epoch_us(started)/1e6, 3) AS seconds
FROM (SELECT run_id, CASE WHEN percent >= 98 THEN 'heatmap' WHEN percent >= 90 THEN 'tiles' WHEN percent >= 75 THEN 'volume' WHEN percent >= 50 THEN 'segmentation'
  WHEN percent >= 35 THEN 'ndsm' WHEN percent >= 25 THEN 'dtm' ELSE 'dsm' END AS phase, min(ts) AS started, max(ts) AS last FROM prog GROUP BY 1, 2)
WINDOW w AS (PARTITION BY run_id ORDER BY started, phase)""", "prog"))
def win_11(spark, d):
    return sm.stage_durations(_progress(spark, d))


@register("WIN-12", query("""
SELECT run_id, count(*) AS messages, count(*) FILTER (percent < before) AS falls, count(*) FILTER (percent < before) = 0 AS monotone
FROM (SELECT run_id, percent, lag(percent) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before FROM prog) GROUP BY 1""", "prog"))
def win_12(spark, d):
    return sm.progress_order(_progress(spark, d))


# ---- scalar functions ----------------------------------------------------
@register("SCL-01", query("""
SELECT heap_id, translate(format('{:,.2f}', volume_m3 * 10), ',.', '.,') AS tenfold, translate(format('{:,}', heap_id * 1000), ',', '.') AS whole FROM heaps""", "heaps"))
def scl_01(spark, d):
    return heap_records(spark, d).select(
        "heap_id", formats.italian_number(F.col("volume_m3") * 10, 2).alias("tenfold"), formats.italian_number(F.col("heap_id") * 1000, 0).alias("whole")
    )


@register("SCL-02", "SELECT event_id, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%d/%m/%Y %H:%M') AS minute FROM events")
def scl_02(spark, d):
    return table(spark, d, "events").select(
        "event_id", formats.italian_date(F.col("ts")).alias("day"), formats.italian_datetime(F.col("ts")).alias("minute")
    )


@register("SCL-03", query("""
SELECT heap_id, printf('%.2f', max_height_m) AS two, printf('%.3f', volume_m3) AS three, printf('%.6f', centroid_e) AS six FROM heaps""", "heaps"))
def scl_03(spark, d):
    return heap_records(spark, d).select(
        "heap_id", formats.fixed(F.col("max_height_m"), 2).alias("two"), formats.fixed(F.col("volume_m3"), 3).alias("three"),
        formats.fixed(F.col("centroid_e"), 6).alias("six"),
    )


@register("SCL-04", query("""
SELECT heap_id, round(volume_m3*pi(), 2) AS two, round(volume_m3*pi(), 3) AS three, round(volume_m3*pi(), 4) AS four FROM heaps""", "heaps"))
def scl_04(spark, d):
    v = F.col("volume_m3") * F.pi()
    return heap_records(spark, d).select("heap_id", F.round(v, 2).alias("two"), F.round(v, 3).alias("three"), F.round(v, 4).alias("four"))


@register("SCL-05", query("""
SELECT heap_id, CAST(floor(volume_m3) AS BIGINT) AS low, CAST(ceil(volume_m3) AS BIGINT) AS high, abs(volume_m3 - 500) AS distance, sqrt(volume_m3) AS root,
  CAST(ceil(log2((heap_id + 1)/256e0)) AS INT) AS zoom, least(1e0, greatest(0e0, mean_height_m - 2)) AS clipped, round(pi()*volume_m3, 6) AS circle FROM heaps""", "heaps"))
def scl_05(spark, d):
    v = F.col("volume_m3")
    return heap_records(spark, d).select(
        "heap_id", F.floor(v).alias("low"), F.ceil(v).alias("high"), F.abs(v - 500).alias("distance"), F.sqrt(v).alias("root"),
        F.ceil(F.log2((F.col("heap_id") + 1) / 256.0)).cast("int").alias("zoom"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean_height_m") - 2)).alias("clipped"), F.round(F.pi() * v, 6).alias("circle"),
    )


@register("SCL-06", query("""
SELECT heap_id, CASE WHEN heap_id % 101 > 3 THEN printf('%.1f%%', (heap_id % 101)/1e0) ELSE '' END AS share, printf('%.0f%%', material_confidence*100) AS confidence
FROM heaps WHERE material_confidence IS NOT NULL""", "heaps"))
def scl_06(spark, d):
    return heap_records(spark, d).where("material_confidence is not null").select(
        "heap_id", formats.percent_text((F.col("heap_id") % 101).cast("double")).alias("share"),
        formats.confidence_text(F.col("material_confidence")).alias("confidence"),
    )


@register("SCL-09", query("""
SELECT heap_id, CASE WHEN heap_id % 5 = 0 THEN NULL ELSE volume_m3 END AS volume_m3, material_category, heap_id % 5 = 0 AS wrote_null FROM heaps""", "heaps"))
def scl_09(spark, d):
    """NaN becomes JSON null, and everything reads back."""
    v = F.when(F.col("heap_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("volume_m3"))
    clean = F.when(~F.isnan(v), v)
    text = F.to_json(F.struct(clean.alias("volume_m3"), F.col("material_category")), {"ignoreNullFields": "false"})
    return heap_records(spark, d).select("heap_id", text.alias("t")).select(
        "heap_id", F.from_json("t", "volume_m3 double, material_category string").alias("p"), F.contains("t", F.lit('"volume_m3":null')).alias("wrote_null")
    ).select("heap_id", "p.*", "wrote_null")


@register("SCL-10", query("""
SELECT heap_id, lower(label) AS low, contains(label, '12') AS has_12, concat(label, '-', heap_id) AS joined, split_part(label, ' ', 2) AS word, trim('  ' || label || ' ') AS trimmed, substring(label, 1, 9) AS head FROM heaps""", "heaps"))
def scl_10(spark, d):
    label = F.col("label")
    return heap_records(spark, d).select(
        "heap_id", F.lower(label).alias("low"), F.contains(label, F.lit("12")).alias("has_12"), F.concat(label, F.lit("-"), F.col("heap_id")).alias("joined"),
        F.split(label, " ")[1].alias("word"), F.trim(F.concat(F.lit("  "), label, F.lit(" "))).alias("trimmed"), F.substring(label, 1, 9).alias("head"),
    )


@register("SCL-11", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, o_orderkey % 6 = 5 AS used_default,
  CAST(epoch_ms(o_orderkey*100000000) AS DATE) AS epoch_day FROM orders""")
def scl_11(spark, d):
    """ISO dates parsed, bad ones flagged for the default; epoch seconds to a UTC date."""
    text = F.when(F.col("o_orderkey") % 6 == 5, F.lit("domani")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    parsed = F.expr("try_to_date(t, 'yyyy-MM-dd')")
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select(
        F.col("o_orderkey").alias("id"), parsed.alias("parsed"), parsed.isNull().alias("used_default"),
        F.to_date(F.timestamp_seconds(F.col("o_orderkey") * 100000)).alias("epoch_day"),
    )


@register("SCL-12", query("""
SELECT heap_id, round(0.1e0*col + 500000e0, 6) AS x, round(5000200e0 - 0.1e0*row, 6) AS y, CAST(col AS DOUBLE) AS col_back, CAST(row AS DOUBLE) AS row_back
FROM (SELECT heap_id, heap_id % 2000 AS col, heap_id*7 % 2000 AS row FROM heaps)""", "heaps"))
def scl_12(spark, d):
    col, row = (F.col("heap_id") % 2000).cast("double"), (F.col("heap_id") * 7 % 2000).cast("double")
    a, z, west, north = F.lit(0.1), F.lit(0.0), F.lit(500000.0), F.lit(5000200.0)
    x, y = cx.affine(col, row, a, z, west, z, -a, north)
    cb, rb = cx.affine_inverse(x, y, a, z, west, z, -a, north)
    return heap_records(spark, d).select(
        "heap_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(cb, 4).alias("col_back"), F.round(rb, 4).alias("row_back")
    )


# ---- batch forms of the streaming jobs -----------------------------------
@register("STR-01", query("""
SELECT survey_id, r, c, min(z) AS min_z, max(z) AS max_z, count(*) AS points, round(quantile_cont(z, 0.95), 6) AS v
FROM binned GROUP BY ALL""", "binned"))
def str_01(spark, d):
    """Cells merged from ingest batches, one of which is replayed; the exact surface comes from the merged heights."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    pts, g = adapter.points(spark, d, "l_linenumber"), stages.grids(spark, d)
    tables = VersionedTables(spark, folder)
    for batch_id in (0, 1, 1, 2):
        jobs.merge_batch(tables, pts.where(F.col("l_linenumber") % 3 == batch_id).drop("l_linenumber"), batch_id, g)
    return jobs.ingested(spark, folder).join(jobs.ingested_surface(spark, folder), ["survey_id", "r", "c"])


@register("STR-02", query(f"""
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, type, count(*) AS messages
FROM ({MSG_SQL}) JOIN (SELECT event_id, ts FROM events) USING (event_id) WHERE type IN ('warning', 'error') GROUP BY 1, 2""", "msg"))
def str_02(spark, d):
    return jobs.warning_windows(jobs.monitor(log_lines(spark, d)))


@register("STR-02-latest", query("""
SELECT run_id, arg_max(CAST(percent AS DOUBLE), struct_pack(a := ts, b := percent)) AS percent, max(ts) AS ts FROM prog GROUP BY 1""", "prog"))
def str_02_latest(spark, d):
    return jobs.latest_progress(jobs.monitor(log_lines(spark, d)))
