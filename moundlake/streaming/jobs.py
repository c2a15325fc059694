"""Structured Streaming jobs: incremental ingest of points and a progress monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from moundlake.operators.quantiles import MICRON, cell_percentile
from moundlake.operators.surface import bin_points
from moundlake.runtime import cut_lineage
from moundlake.schema import POINTS
from moundlake.sinks.versions import VersionedTables
from moundlake.sources.messages import parse_messages

BAND_ROWS = 256  # grid lines of a band, the part of a survey that a batch rewrites


def point_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of points as a stream."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cell_heights(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Mergeable state per cell: every distinct height with its number of points, in bands of ``BAND_ROWS`` grid lines."""
    counted = bin_points(points, grids).where("z is not null").groupBy("survey_id", "r", "c", F.round("z", MICRON).alias("z")).agg(
        F.count(F.lit(1)).alias("points")
    )
    return counted.withColumn("part", F.floor(F.col("r") / BAND_ROWS).cast("int"))


def merge_batch(tables: VersionedTables, batch: DataFrame, batch_id: int, grids: DataFrame) -> None:
    """Merge one batch of points into the heights in force; a batch that is merged already changes nothing.

    Only the bands that the batch touches are read and written anew, as one commit marked with the batch.
    """
    done = tables.mark()
    if done is not None and batch_id <= done:
        return
    fresh = cut_lineage(cell_heights(batch, grids))
    merged, old = fresh, tables.read("heights", only=fresh)
    if old is not None:
        both = old.select(fresh.columns).unionByName(fresh)
        merged = both.groupBy("survey_id", "r", "c", "z", "part").agg(F.sum("points").alias("points"))
    tables.commit({"heights": merged}, mark=batch_id)


def ingest(stream: DataFrame, grids: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Merge every micro-batch of points into the table of cell heights.

    A replayed batch is skipped by its mark, and one that was lost half-way left no manifest, so a lost executor or a restarted
    query never counts points twice. Files stay in proportion to the bands, not to the batches.
    """
    tables = VersionedTables(stream.sparkSession, table)
    return stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(tables, batch, batch_id, grids)).option(
        "checkpointLocation", checkpoint
    )


def ingested(spark: SparkSession, table: str, since: int | None = None) -> DataFrame:
    """``(survey_id, r, c, min_z, max_z, points)`` of all cells, or of the bands that changed after version ``since``."""
    heights = VersionedTables(spark, table).read("heights", since=since)
    if heights is None:
        return spark.createDataFrame([], "survey_id long, r int, c int, min_z double, max_z double, points long")
    return heights.groupBy("survey_id", "r", "c").agg(
        F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.sum("points").alias("points")
    )


def ingested_surface(spark: SparkSession, table: str, q: float = 0.95, since: int | None = None) -> DataFrame:
    """Exact surface quantile of the cells from the merged heights; no point is read again.

    With ``since`` only the bands that changed after that version are computed, for a refresh of an older surface.
    """
    heights = VersionedTables(spark, table).read("heights", since=since)
    if heights is None:
        return spark.createDataFrame([], "survey_id long, r int, c int, v double")
    return cell_percentile(heights, ["survey_id", "r", "c"], "z", q, "v", weight="points")


def latest_progress(messages: DataFrame) -> DataFrame:
    """Latest percentage per run (batch or stream in update mode)."""
    return messages.where("type = 'progress'").groupBy("run_id").agg(
        F.max_by("percent", F.struct("ts", "percent")).alias("percent"), F.max("ts").alias("ts")
    )


def warning_windows(messages: DataFrame, late: str = "1 hour", length: str = "6 hours") -> DataFrame:
    """Messages of type warning or error per tumbling window."""
    if messages.isStreaming:
        messages = messages.withWatermark("ts", late)
    return (
        messages.where("type in ('warning', 'error')")
        .groupBy(F.window("ts", length).alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(F.col("w.start").alias("window_start"), "type", "messages")
    )


def monitor(lines: DataFrame) -> DataFrame:
    """Parsed messages of a text stream ``(run_id, ts, value)``."""
    return parse_messages(lines)
