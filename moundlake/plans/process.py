"""Process surveys: points to heap metrics, all surveys in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.operators import neighbourhood as nb
from moundlake.operators import segments, shapes, surface, tiles, zonal
from moundlake.operators.quantiles import group_percentile
from moundlake.runtime import bounded_broadcast, cut_lineage
from moundlake.schema import CONFIG_DEFAULTS


# Settings that every survey can have for itself; the others hold for a whole job.
PER_SURVEY = ["height_threshold", "min_heap_area", "max_heap_area", "morpho_kernel_size", "ground_classification_opening_m"]


@dataclass(frozen=True)
class Config:
    """Settings of one job; those in ``PER_SURVEY`` are the defaults of surveys without their own."""

    height_threshold: float = CONFIG_DEFAULTS["height_threshold"]
    min_heap_area: float = CONFIG_DEFAULTS["min_heap_area"]
    max_heap_area: float = CONFIG_DEFAULTS["max_heap_area"]
    base_percentile: float = CONFIG_DEFAULTS["base_percentile"]
    morpho_kernel_size: int = CONFIG_DEFAULTS["morpho_kernel_size"]
    ground_classification_opening_m: float = CONFIG_DEFAULTS["ground_classification_opening_m"]
    use_ground_classification: bool = CONFIG_DEFAULTS["use_ground_classification"]
    open_k: int = 3
    close_k: int = 7


@dataclass(frozen=True)
class Result:
    surface: DataFrame      # survey_id, r, c, v
    terrain: DataFrame      # survey_id, base, method, confidence, notes
    height: DataFrame       # survey_id, r, c, v
    labels: DataFrame       # survey_id, r, c, heap_id
    classified: DataFrame   # one row per component, with its box
    metrics: DataFrame      # one row per accepted heap
    grids: DataFrame

    def outlines(self) -> DataFrame:
        """``(survey_id, heap_id, rings)`` of the accepted heaps; linked and ordered when asked for."""
        return shapes.outlines(self.labels.join(self.metrics.select("survey_id", "heap_id"), ["survey_id", "heap_id"], "left_semi"), self.grids)

    def heaps(self) -> DataFrame:
        """Accepted heaps with metrics and rings: what comparisons and exports take."""
        return self.metrics.join(self.outlines(), ["survey_id", "heap_id"])


def with_settings(grids: DataFrame, config: Config, configs: DataFrame | None) -> DataFrame:
    """``grids`` with a column per setting in ``PER_SURVEY``: the survey's own of ``configs``, else that of ``config``.

    ``configs`` is what ``parse_config`` gives; surveys whose configuration has an error are left out.
    """
    bare = grids.drop(*PER_SURVEY)
    default = {n: F.lit(getattr(config, n)) for n in PER_SURVEY}
    if configs is None:
        return bare.withColumns(default)
    own = [n for n in PER_SURVEY if n in configs.columns]
    broken = configs.where("error is not null").select("survey_id") if "error" in configs.columns else None
    if broken is not None:
        bare = bare.join(bounded_broadcast(broken), "survey_id", "left_anti")
    named = bounded_broadcast(configs.select("survey_id", *[F.col(n).alias(f"_{n}") for n in own]))
    settled = {n: F.coalesce(F.col(f"_{n}"), default[n]) if n in own else default[n] for n in PER_SURVEY}
    return bare.join(named, "survey_id", "left").withColumns(settled).drop(*[f"_{n}" for n in own])


def terrain_rasters(
    surface_cells: DataFrame,
    points: DataFrame,
    grids: DataFrame,
    config: Config,
    manual: DataFrame | None = None,
    regions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Terrain cells and the per-survey summary, by the first strategy that applies.

    Order: manual base, ground regions, classified points (coverage gate), automatic.
    Survey ids are split first, so a strategy only touches the surveys that need it. ``grids`` can carry settings per survey.
    """
    left = grids if set(PER_SURVEY) <= set(grids.columns) else with_settings(grids, config, None)
    rasters, summaries = [], []

    def flat(bases: DataFrame) -> DataFrame:
        return surface_cells.join(bounded_broadcast(bases.select("survey_id", "base")), "survey_id").select(
            "survey_id", "r", "c", F.col("base").alias("v")
        )

    def summary(bases: DataFrame, method, confidence, notes) -> DataFrame:
        return bases.select(
            "survey_id", "base", method.alias("method"), confidence.alias("confidence"), notes.alias("notes")
        )

    if manual is not None:
        chosen = manual.select("survey_id", F.col("base").cast("double").alias("base")).where("base is not null")
        rasters.append(flat(chosen))
        summaries.append(
            summary(
                chosen, F.lit("manual"), F.lit(1.0),
                F.format_string("Base elevation set by hand: %.2f m", "base"),
            )
        )
        left = left.join(bounded_broadcast(chosen.select("survey_id")), "survey_id", "left_anti")
    if regions is not None:
        ids = bounded_broadcast(regions.select("survey_id").distinct())
        here = left.join(ids, "survey_id", "left_semi")
        chosen = surface.ground_region_base(
            surface_cells.join(bounded_broadcast(here.select("survey_id")), "survey_id", "left_semi"), here, regions
        )
        rasters.append(flat(chosen))
        summaries.append(
            summary(
                chosen, F.lit("ground_regions"), F.lit(1.0),
                F.format_string("Base elevation from ground regions: %.2f m", "base"),
            )
        )
        left = left.join(ids, "survey_id", "left_anti")
    if not left.isEmpty():
        ground_only = config.use_ground_classification
        ids = bounded_broadcast(left.select("survey_id"))
        ground, covered = surface.terrain_from_points(
            points.join(ids, "survey_id", "left_semi"), left, ground_only, F.col("ground_classification_opening_m")
        )
        # cells empty in the surface stay empty in the terrain
        known = surface_cells.where("v is not null").select("survey_id", "r", "c")
        ground = cut_lineage(ground.join(known, ["survey_id", "r", "c"], "left_semi"))
        low = group_percentile(ground, ["survey_id"], "v", config.base_percentile / 100.0, "base")
        rasters.append(ground)
        summaries.append(
            summary(
                low.join(covered, "survey_id"), F.lit("ground_classification"),
                F.lit(0.95 if ground_only else 0.80),
                F.format_string("Terrain from points, coverage %.1f%%, base %.2f m", F.col("coverage") * 100, "base"),
            )
        )
        rest = left.join(covered.where("passes").select("survey_id"), "survey_id", "left_anti")
        if not rest.isEmpty():
            ids = bounded_broadcast(rest.select("survey_id"))
            part = surface_cells.join(ids, "survey_id", "left_semi")
            opened, auto = surface.automatic_base(part, rest, F.col("morpho_kernel_size"), config.base_percentile)
            rasters.append(opened)
            summaries.append(
                summary(
                    auto, F.col("method"), F.col("confidence"),
                    F.format_string("Morphological %.3f m, peripheral %.3f m", "morpho", "periph"),
                )
            )
    cells, table = rasters[0], summaries[0]
    for other in rasters[1:]:
        cells = cells.unionByName(other)
    for other in summaries[1:]:
        table = table.unionByName(other)
    return cells, table


def measure(height: DataFrame, grids: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, classified components and accepted-heap metrics of a height raster.

    ``height`` feeds the tiles and the gradient, so pass it written out. Mask, labels and statistics take one exchange of the cells.
    """
    if not set(PER_SURVEY) <= set(grids.columns):
        grids = with_settings(grids, config, None)
    runs = tiles.segment(height, grids, F.col("height_threshold"), config.open_k, config.close_k)
    labels = tiles.run_cells(runs)
    limits = bounded_broadcast(grids.select("survey_id", "min_heap_area", "max_heap_area"))
    statistics = tiles.run_statistics(runs, grids).join(limits, "survey_id")
    classified = segments.classify(statistics, F.col("min_heap_area"), F.col("max_heap_area")).drop("min_heap_area", "max_heap_area")
    thresholds = bounded_broadcast(grids.select("survey_id", "height_threshold"))
    sloped = zonal.with_gradient(height, grids).join(thresholds, "survey_id")
    metrics = zonal.heap_metrics(labels, sloped, F.col("height_threshold"))
    kept = classified.where("not is_filtered").select("survey_id", "heap_id")
    return labels, classified, metrics.join(kept, ["survey_id", "heap_id"])


def process(
    points: DataFrame,
    grids: DataFrame,
    config: Config | None = None,
    manual: DataFrame | None = None,
    regions: DataFrame | None = None,
    imported: DataFrame | None = None,
    configs: DataFrame | None = None,
) -> Result:
    """Surface, terrain, heights, heaps and metrics for every survey in ``grids``, all in one job.

    ``configs`` holds settings per survey (``PER_SURVEY``), ``manual_base_elevation`` among them; they come before ``config``.
    """
    config = config or Config()
    grids = cut_lineage(with_settings(grids, config, configs))
    if configs is not None and "manual_base_elevation" in configs.columns:
        own = configs.select("survey_id", F.col("manual_base_elevation").cast("double").alias("base")).where("base is not null")
        manual = own if manual is None else own.unionByName(manual.select("survey_id", F.col("base").cast("double").alias("base")).join(own, "survey_id", "left_anti"))
    surface_cells = cut_lineage(surface.generate_surface(points, grids, imported))
    terrain, summary = terrain_rasters(surface_cells, points, grids, config, manual, regions)
    height = cut_lineage(surface.height_cells(surface_cells, terrain))
    labels, classified, metrics = measure(height, grids, config)
    metrics = metrics.join(summary.select("survey_id", F.col("base").alias("base_elevation_m")), "survey_id")
    return Result(surface_cells, summary, height, labels, classified, metrics, grids)
