"""Compare surveys: every requested pair of surveys in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundlake.operators import compare
from moundlake.runtime import bounded_broadcast, cut_lineage


@dataclass(frozen=True)
class Comparison:
    iou: DataFrame
    matched: DataFrame
    removed: DataFrame
    added: DataFrame
    changes: DataFrame
    summary: DataFrame


def compare_surveys(
    heaps: DataFrame,
    pairs: DataFrame,
    iou_threshold: float = compare.IOU_THRESHOLD,
    stability: float = compare.STABILITY_THRESHOLD,
    iou: DataFrame | None = None,
) -> Comparison:
    """Match survey A with survey B for each row of ``pairs(pair_id, survey_a, survey_b)``.

    ``heaps(survey_id, heap_id, rings, volume_m3, planimetric_area_m2, max_height_m)``
    can come from a processing run or from edited records. A ready IoU table
    (raster overlap) may be passed instead of polygons.
    """
    small = bounded_broadcast(pairs)
    a = heaps.join(small, heaps["survey_id"] == small["survey_a"]).drop("survey_a", "survey_b")
    b = heaps.join(small, heaps["survey_id"] == small["survey_b"]).drop("survey_a", "survey_b")
    if iou is None:
        iou = compare.polygon_iou(compare.candidate_pairs(a, b))
    iou = cut_lineage(iou)
    matches = compare.assign(iou, iou_threshold)
    matched = cut_lineage(
        compare.mark_ambiguous(compare.describe_matches(matches, a, b, stability), iou, iou_threshold)
    )
    removed, added = compare.unmatched(matched, a, b)
    changes = compare.change_table(matched, removed, added)
    return Comparison(iou, matched, removed, added, changes, compare.match_summary(changes, a, b, pairs))


def heap_chains(links: DataFrame, heaps: DataFrame) -> DataFrame:
    """``(survey_id, heap_id, chain_survey, chain_heap, step)``: the first heap of each heap's chain of matches and the links to it.

    ``links(survey_a, heap_a, survey_b, heap_b)`` lead from a heap to the one it became, one at most on either side. Pointer doubling: every
    round a heap takes over the place its own place points to, so rounds grow with the logarithm of the number of surveys.
    """
    before = links.select(
        F.col("survey_b").alias("survey_id"), F.col("heap_b").alias("heap_id"), F.col("survey_a").alias("chain_survey"), F.col("heap_a").alias("chain_heap")
    )
    known = heaps.select("survey_id", "heap_id").join(before, ["survey_id", "heap_id"], "left").select(
        "survey_id", "heap_id", F.coalesce("chain_survey", "survey_id").alias("chain_survey"), F.coalesce("chain_heap", "heap_id").alias("chain_heap"),
        F.col("chain_survey").isNotNull().cast("int").alias("step"),
    )
    known = cut_lineage(known)
    while True:
        ahead = known.where("step > 0").select(
            F.col("survey_id").alias("chain_survey"), F.col("heap_id").alias("chain_heap"),
            F.col("chain_survey").alias("_survey"), F.col("chain_heap").alias("_heap"), F.col("step").alias("_step"),
        )
        joined = known.join(ahead, ["chain_survey", "chain_heap"], "left")
        known = cut_lineage(joined.select(
            "survey_id", "heap_id", F.coalesce("_survey", "chain_survey").alias("chain_survey"), F.coalesce("_heap", "chain_heap").alias("chain_heap"),
            (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"), F.col("_step").isNotNull().alias("moved"),
        ))
        if known.where("moved").isEmpty():
            return known.drop("moved")


def volume_timeline(changes: DataFrame, heaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Volume of each heap at each survey along its chain of matches, with the change since the survey before and since the first.

    ``pairs`` hold consecutive surveys of a site, any number of them. A heap that is lost and found again starts a new chain.
    """
    links = changes.where("heap_a is not null and heap_b is not null").join(bounded_broadcast(pairs), "pair_id")
    chains = heap_chains(links.select("survey_a", "heap_a", "survey_b", "heap_b"), heaps)
    along = Window.partitionBy("chain_survey", "chain_heap").orderBy("step")
    volume = F.col("volume_m3")
    return heaps.select("survey_id", "heap_id", "volume_m3").join(chains, ["survey_id", "heap_id"]).select(
        "survey_id", "heap_id", "volume_m3", "chain_survey", "chain_heap", "step", F.lag("heap_id").over(along).alias("previous_heap_id"),
        F.lag(volume).over(along).alias("previous_m3"), F.round(volume - F.lag(volume).over(along), 6).alias("delta_m3"),
        F.round(volume - F.first(volume).over(along), 6).alias("since_first_m3"),
    )
