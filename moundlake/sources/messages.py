"""Progress-message logs: JSON Lines with tolerant parsing, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundlake.schema import MESSAGE

# Message types, and the progress bands of the processing phases.
MESSAGE_TYPES = ["progress", "result", "error", "warning"]
PHASE_BANDS = [
    (0, "dsm"), (25, "dtm"), (35, "ndsm"), (50, "segmentation"), (75, "volume"), (90, "tiles"), (98, "heatmap"),
]
EXCERPT = 200


def parse_messages(lines: DataFrame, text: str = "value") -> DataFrame:
    """Typed messages; malformed lines become warnings with an excerpt, blank lines vanish.

    Works on a batch and on a stream alike.
    """
    bom = F.regexp_replace(F.col(text), "^﻿", "")
    line = F.trim(F.regexp_replace(bom, "[\r\n]+$", ""))
    parsed = F.from_json(line, MESSAGE, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_line", line).where(F.length("_line") > 0).withColumn("_m", parsed)
    is_json = F.get_json_object("_line", "$").isNotNull() & F.col("_line").startswith("{")
    kind = F.get_json_object("_line", "$.type")
    excerpt = F.substring("_line", 1, EXCERPT)
    warning = (
        F.when(~is_json, F.concat(F.lit("Non-JSON line: "), excerpt))
        .when(kind.isNull(), F.concat(F.lit("Line without type: "), excerpt))
        .when(~kind.isin(MESSAGE_TYPES), F.concat(F.lit("Unknown type '"), kind, F.lit("': "), excerpt))
    )
    rows = rows.withColumn("_w", warning)
    keep = [c for c in lines.columns if c != text]
    return rows.select(
        *keep,
        F.when(F.col("_w").isNull(), F.col("_m.type")).otherwise(F.lit("warning")).alias("type"),
        F.when(F.col("_w").isNull(), F.col("_m.phase")).alias("phase"),
        F.when(F.col("_w").isNull(), F.col("_m.percent")).alias("percent"),
        F.coalesce("_w", "_m.message").alias("message"),
        F.when(F.col("_w").isNull(), F.col("_m.code")).alias("code"),
    )


def phase_of(percent: Column) -> Column:
    """Phase of a progress percentage: the highest band at or below it."""
    phase = F.lit(PHASE_BANDS[0][1])
    for start, name in PHASE_BANDS[1:]:
        phase = F.when(percent >= start, F.lit(name)).otherwise(phase)
    return phase


def stage_durations(progress: DataFrame) -> DataFrame:
    """Seconds from the first message of a phase to the first of the next, per run.

    The last phase lasts until the last message of the run.
    """
    starts = progress.withColumn("phase", phase_of(F.col("percent"))).groupBy("run_id", "phase").agg(
        F.min("ts").alias("started"), F.max("ts").alias("_last")
    )
    order = Window.partitionBy("run_id").orderBy("started", "phase")
    seconds = lambda ts: F.unix_micros(ts.cast("timestamp")).cast("double") / 1e6
    end = F.coalesce(F.lead("started").over(order), F.max("_last").over(Window.partitionBy("run_id")))
    return starts.withColumn("_end", end).select(
        "run_id", "phase", "started",
        F.round(seconds(F.col("_end")) - seconds(F.col("started")), 3).alias("seconds"),
    )


def progress_order(progress: DataFrame, bucket: str = "hour") -> DataFrame:
    """Per run: whether percentages never fall, and how often they do.

    Neighbours are compared inside time buckets of a run, then across the ends of
    neighbouring buckets, so a run with most of the messages is never one task.
    """
    order = F.struct("ts", "seq")
    inside = Window.partitionBy("run_id", "_bucket").orderBy("ts", "seq")
    buckets = (
        progress.withColumn("_bucket", F.date_trunc(bucket, F.col("ts")))
        .withColumn("_before", F.lag("percent").over(inside))
        .groupBy("run_id", "_bucket")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("percent") < F.col("_before")).alias("_falls"),
            F.min_by("percent", order).alias("_first"),
            F.max_by("percent", order).alias("_last"),
        )
    )
    previous = F.lag("_last").over(Window.partitionBy("run_id").orderBy("_bucket"))
    return (
        buckets.withColumn("_previous", previous)
        .groupBy("run_id")
        .agg(
            F.sum("_n").alias("messages"),
            (F.sum("_falls") + F.count_if(F.col("_first") < F.col("_previous"))).alias("falls"),
        )
        .withColumn("monotone", F.col("falls") == 0)
    )
