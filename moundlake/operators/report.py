"""Report and catalogue queries over heap records, surveys and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundlake.functions.formats import percent_text
from moundlake.runtime import bounded_broadcast, broadcast_aggregate, cut_lineage
from moundlake.sinks.versions import VersionedTables


# ---- filters -------------------------------------------------------------
def exportable(heaps: DataFrame) -> DataFrame:
    return heaps.where("not is_excluded")


def guard_not_empty(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, or an error when it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def reportable(heaps: DataFrame) -> DataFrame:
    return heaps.where("is_manually_confirmed or material_category is not null")


def low_confidence(confidence: Column, classified_by: Column, limit: float = 0.7) -> Column:
    return F.coalesce(
        (confidence < limit) & classified_by.isNotNull() & (classified_by != "") & (classified_by != "manual"),
        F.lit(False),
    )


def text_filter(heaps: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of label, category or #id."""
    haystack = F.concat_ws(
        " ", F.col("label"), F.col("material_category"), F.concat(F.lit("#"), F.col("heap_id").cast("string"))
    )
    return heaps.where(F.contains(F.lower(haystack), F.lit(text.lower())))


def export_preview(heaps: DataFrame, keys: list[str]) -> DataFrame:
    """How many heaps each combination of the two export switches would keep."""
    used, confirmed = ~F.col("is_excluded"), F.col("is_manually_confirmed")
    return heaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_heaps"),
        F.count_if(used).alias("without_excluded"),
        F.count_if(confirmed).alias("confirmed_only"),
        F.count_if(used & confirmed).alias("both"),
    )


def too_small(area: Column) -> Column:
    return area < 0.5


def anomalous(area: Column, survey_area: Column) -> Column:
    return (survey_area > 0) & (area > survey_area / 2.0)


# ---- aggregates ----------------------------------------------------------
def site_summary(heaps: DataFrame, keys: list[str]) -> DataFrame:
    return heaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("heap_count"),
        F.round(F.sum("volume_m3"), 3).alias("total_volume_m3"),
        F.round(F.sum("planimetric_area_m2"), 3).alias("total_area_m2"),
        F.round(F.avg("mean_height_m"), 6).alias("mean_height_m"),
    )


def survey_summary(heaps: DataFrame) -> DataFrame:
    """Total, average and largest heap; among equal volumes the last id wins."""
    return heaps.groupBy("survey_id").agg(
        F.round(F.sum("volume_m3"), 3).alias("total_volume_m3"),
        F.round(F.avg("volume_m3"), 6).alias("average_volume_m3"),
        F.max_by("heap_id", F.struct("volume_m3", "heap_id")).alias("largest_heap_id"),
        F.max("volume_m3").alias("largest_volume_m3"),
    )


def category_volumes(heaps: DataFrame, keys: list[str]) -> DataFrame:
    """Volume per category (NULL is its own group), share of the total and its label."""
    total = F.sum("volume").over(Window.partitionBy(*keys))
    return (
        heaps.groupBy(*keys, "material_category")
        .agg(F.sum("volume_m3").alias("volume"))
        .withColumn("share", F.when(total > 0, F.col("volume") / total * 100))
        .select(
            *keys, "material_category", F.round("volume", 3).alias("volume_m3"), F.round("share", 6).alias("share_percent"),
            percent_text(F.col("share")).alias("share_label"),
        )
    )


def volume_histogram(heaps: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-width bins over the positive volumes; min(10, max(3, n // 2)) bins, top edge inclusive.

    Empty bins are kept.
    """
    positive = heaps.where("volume_m3 > 0")
    ranges = positive.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("volume_m3").alias("lo"), F.max("volume_m3").alias("hi")
    ).withColumn("bins", F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.col("n") / 2).cast("int"))))
    # a single value gets a bin range of one unit around it
    flat = F.col("hi") == F.col("lo")
    ranges = ranges.withColumn("lo2", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn(
        "hi2", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    )
    ranges = cut_lineage(ranges)
    small = bounded_broadcast(ranges)
    width = (F.col("hi2") - F.col("lo2")) / F.col("bins")
    counted = positive.join(small, keys).select(
        *keys, F.least(F.floor((F.col("volume_m3") - F.col("lo2")) / width).cast("int"), F.col("bins") - 1).alias("bin")
    ).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("heaps"))
    frame = ranges.select(*keys, "lo2", width.alias("w"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return frame.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin",
        F.round(F.col("lo2") + F.col("bin") * F.col("w"), 6).alias("bin_from"),
        F.round(F.col("lo2") + (F.col("bin") + 1) * F.col("w"), 6).alias("bin_to"),
        F.coalesce("heaps", F.lit(0).cast("bigint")).alias("heaps"),
    )


def run_checks(heaps: DataFrame, site_area: DataFrame) -> DataFrame:
    """Plausibility of a run: positive and bounded volumes, no spanning heap, no dominating heap."""
    return (
        heaps.groupBy("survey_id")
        .agg(
            F.min("volume_m3").alias("lo"), F.max("volume_m3").alias("hi"), F.sum("volume_m3").alias("total"),
            F.max("planimetric_area_m2").alias("largest_area"), F.min("planimetric_area_m2").alias("least_area"),
            F.min("max_height_m").alias("least_height"),
        )
        .join(site_area, "survey_id")
        .select(
            "survey_id",
            ((F.col("lo") > 0) & (F.col("least_area") > 0) & (F.col("least_height") > 0)).alias("all_positive"),
            (F.col("hi") < 1e8).alias("volumes_bounded"),
            (F.col("largest_area") < 0.3 * F.col("site_area_m2")).alias("no_spanning_heap"),
            ((F.col("total") > 0) & (F.col("hi") / F.col("total") < 0.6)).alias("no_dominating_heap"),
        )
    )


def shares(heaps: DataFrame, keys: list[str]) -> DataFrame:
    """Each heap's share of its survey's volume, from totals joined back (no survey-wide window)."""
    totals = heaps.groupBy(*keys).agg(F.sum("volume_m3").alias("_total"))
    return heaps.join(broadcast_aggregate(totals), keys).withColumn(
        "volume_share", F.when(F.col("_total") > 0, F.round(F.col("volume_m3") / F.col("_total"), 9))
    ).drop("_total")


# ---- orders --------------------------------------------------------------
def heap_order(heaps: DataFrame, by: str) -> DataFrame:
    """The heap list orders; heaps without category come last under ``category``."""
    orders = {
        "id": [F.asc("heap_id")],
        "volume": [F.desc("volume_m3"), F.asc("heap_id")],
        "area": [F.desc("planimetric_area_m2"), F.asc("heap_id")],
        "height": [F.desc("max_height_m"), F.asc("heap_id")],
        "category": [F.coalesce("material_category", F.lit("zzz")).asc(), F.asc("heap_id")],
    }
    return heaps.orderBy(*orders[by])


def top_heaps(heaps: DataFrame, measure: str, k: int) -> DataFrame:
    """The k largest heaps of each survey.

    A rank filter lets Spark keep only k rows per partition before the shuffle.
    """
    order = Window.partitionBy("survey_id").orderBy(F.desc(measure), F.asc("heap_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stacked_volumes(heaps: DataFrame) -> DataFrame:
    """Volume per survey and category, whatever the categories are, beside the survey's total; a missing category is "unclassified"."""
    category = F.coalesce("material_category", F.lit("unclassified")).alias("category")
    parts = heaps.groupBy("survey_id", category).agg(F.sum("volume_m3").alias("volume_m3"))
    whole = Window.partitionBy("survey_id")  # a few rows, one a category
    return parts.withColumn("total_m3", F.sum("volume_m3").over(whole))


# ---- joins of records ----------------------------------------------------
def enrich(edited: DataFrame, measured: DataFrame, fields: list[str]) -> DataFrame:
    """Edited values win over measured ones; NULL and the type's empty value (0, "", false) fall through to the next."""
    other = measured.select("survey_id", "heap_id", *[F.col(f).alias(f"_m_{f}") for f in fields])
    joined = edited.join(other, ["survey_id", "heap_id"], "left")

    def pick(name: str) -> Column:
        kind = edited.schema[name].dataType
        if isinstance(kind, T.StringType):
            none = F.lit("")
        elif isinstance(kind, T.BooleanType):
            none = F.lit(False)
        elif isinstance(kind, T.NumericType):
            none = F.lit(0).cast(kind)
        else:  # dates, arrays and the like have no empty value
            return F.coalesce(F.col(name), F.col(f"_m_{name}")).alias(name)
        return F.coalesce(F.nullif(F.col(name), none), F.nullif(F.col(f"_m_{name}"), none), none).alias(name)

    keep = [c for c in edited.columns if c not in fields]
    return joined.select(*keep, *[pick(f) for f in fields])


def with_classification(heaps: DataFrame, classes: DataFrame) -> DataFrame:
    """Heaps with their classification row; missing rows give NULL and false."""
    return heaps.join(classes, ["survey_id", "heap_id"], "left").withColumn(
        "is_manually_confirmed", F.coalesce("is_manually_confirmed", F.lit(False))
    )


def cascade_delete(projects: DataFrame, surveys: DataFrame, heaps: DataFrame, doomed: DataFrame):
    """Remove projects with their surveys and heaps."""
    gone = bounded_broadcast(doomed.select("project_id"))
    kept_projects = projects.join(gone, "project_id", "left_anti")
    lost_surveys = bounded_broadcast(surveys.join(gone, "project_id", "left_semi").select("survey_id"))
    kept_surveys = surveys.join(lost_surveys, "survey_id", "left_anti")
    return kept_projects, kept_surveys, heaps.join(lost_surveys, "survey_id", "left_anti")


def nearest_reference(heaps: DataFrame, references: DataFrame, per_block: float = 2.0) -> DataFrame:
    """Nearest reference heap of each heap by centroid, within the survey; ties go to the smaller id.

    Both sides meet in square blocks, sized so that one holds ``per_block`` references of its survey on average. A heap looks at the three by
    three blocks around it and is settled when the best of them is no farther than a block is wide, as all others are.
    Only heaps that aren't look again with blocks twice as wide.
    """
    extent = references.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("_n"), F.greatest(F.max("ref_e") - F.min("ref_e"), F.max("ref_n") - F.min("ref_n")).alias("_side")
    )
    reach = heaps.groupBy("survey_id").agg(
        F.min("centroid_e").alias("_e1"), F.max("centroid_e").alias("_e2"), F.min("centroid_n").alias("_n1"), F.max("centroid_n").alias("_n2")
    )
    around = references.groupBy("survey_id").agg(
        F.min("ref_e").alias("_f1"), F.max("ref_e").alias("_f2"), F.min("ref_n").alias("_m1"), F.max("ref_n").alias("_m2")
    )
    # no heap is farther from a reference than the side of the square around all of a survey's
    farthest = F.greatest(
        F.greatest("_e2", "_f2") - F.least("_e1", "_f1"), F.greatest("_n2", "_m2") - F.least("_n1", "_m1"), F.lit(1.0)
    )
    width = F.greatest(F.col("_side") / F.sqrt(F.col("_n") / F.lit(per_block)), farthest / 2.0**30, F.lit(1e-6))
    sizes = extent.join(reach, "survey_id").join(around, "survey_id").select("survey_id", width.alias("_width"), farthest.alias("_all"))
    sizes = broadcast_aggregate(sizes)
    known = references.select("survey_id", "ref_id", "ref_e", "ref_n").join(sizes, "survey_id")
    left = heaps.select("survey_id", "heap_id", "centroid_e", "centroid_n").join(sizes, "survey_id")
    block = lambda at, scale: F.floor(F.col(at) / (F.col("_width") * scale)).cast("long")
    done, scale = None, 1.0
    while True:
        steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        asked = left.withColumn("bx", F.explode(F.transform(steps, lambda k: block("centroid_e", scale) + k))).withColumn(
            "by", F.explode(F.transform(steps, lambda k: block("centroid_n", scale) + k))
        )
        here = known.select("survey_id", "ref_id", "ref_e", "ref_n", block("ref_e", scale).alias("bx"), block("ref_n", scale).alias("by"))
        de, dn = F.col("centroid_e") - F.col("ref_e"), F.col("centroid_n") - F.col("ref_n")
        found = asked.join(here, ["survey_id", "bx", "by"]).groupBy("survey_id", "heap_id").agg(
            F.min(F.struct((de * de + dn * dn).alias("d2"), "ref_id")).alias("best")
        )
        met = cut_lineage(left.join(found, ["survey_id", "heap_id"], "left"))
        whole = F.col("_width") * scale >= F.col("_all")
        settled = F.coalesce(F.sqrt("best.d2") <= F.col("_width") * scale, F.lit(False)) | whole
        near = met.where(settled).select("survey_id", "heap_id", F.col("best.ref_id").alias("ref_id"), F.round(F.sqrt("best.d2"), 6).alias("distance_m"))
        done = near if done is None else done.unionByName(near)
        left = met.where(~settled).drop("best")
        if left.isEmpty():
            return done
        scale *= 2


def replace_rows(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """New version of a table: rows of ``fresh`` replace those with the same keys."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def replace_bases(tables: VersionedTables, fresh: DataFrame) -> int:
    """New base elevations ``(survey_id, base)`` and the volumes over them, for the heaps and surveys of ``tables``, as one commit.

    A volume changes by its area times the rise of the base and doesn't fall below zero. Until the commit is whole, readers
    see heaps and bases as they were.
    """
    ids = fresh.select("survey_id").distinct()
    old = tables.read("surveys", only=ids.withColumn("part", F.lit(0)))
    bases = old.join(fresh.select("survey_id", F.col("base").alias("_base")), "survey_id")
    moved = bases.select("survey_id", (F.col("_base") - F.col("base")).alias("_rise"))
    heaps = tables.read("heaps", only=ids.withColumn("part", F.lit(0))).join(bounded_broadcast(moved), "survey_id")
    volume = F.round(F.greatest(F.col("volume_m3") - F.col("_rise") * F.col("planimetric_area_m2"), F.lit(0.0)), 6)
    return tables.commit({
        "heaps": heaps.withColumn("volume_m3", volume).drop("_rise"), "surveys": bases.withColumn("base", F.col("_base")).drop("_base"),
    })


def restore_snapshot(table: DataFrame, delete_ids: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Undo: drop the given ids, put the saved rows back."""
    return table.join(delete_ids, "heap_id", "left_anti").unionByName(snapshot)


def part_labels(parts: DataFrame) -> DataFrame:
    """Labels of the parts of a split heap: name (i/n)."""
    by = Window.partitionBy("survey_id", "heap_id")
    return parts.withColumn("_i", F.row_number().over(by.orderBy("part"))).withColumn(
        "_n", F.count(F.lit(1)).over(by)
    ).withColumn(
        "label", F.format_string("%s (%d/%d)", "label", "_i", "_n")
    ).drop("_i", "_n")


def next_labels(heaps: DataFrame) -> DataFrame:
    """Label of the next new heap per survey."""
    return heaps.groupBy("survey_id").agg((F.count(F.lit(1)) + 1).alias("next_number")).withColumn(
        "next_label", F.format_string("Cumulo %d", "next_number")
    )


def merged_labels(groups: DataFrame) -> DataFrame:
    return groups.withColumn("label", F.format_string("Cumuli uniti (%d)", "members"))


def classification_ingest(heaps: DataFrame, results: DataFrame) -> DataFrame:
    """Model categories from JSON text; a manual category wins; flags low confidence."""
    parsed = F.from_json("result", "category string, confidence double")
    rows = results.select("survey_id", "heap_id", parsed.alias("p"))
    category = F.coalesce("manual_category", "p.category")
    confidence = F.when(F.col("manual_category").isNull(), F.col("p.confidence"))
    return heaps.join(rows, ["survey_id", "heap_id"], "left").select(
        "survey_id", "heap_id", category.alias("material_category"), confidence.alias("material_confidence"),
        F.coalesce(confidence < 0.7, F.lit(False)).alias("low_confidence"),
        F.col("manual_category").isNotNull().alias("is_manual"),
    )
