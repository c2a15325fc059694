"""Exact duplicates by sorting contents, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundlake.llm.common import cut_lineage

# The range splitters compare this many leading characters, then a 64-bit hash. Splitters only
# deal rows out; equality is decided on whole contents.
SPLITTER_CHARS = 24
# Contents with at least 1/HOT_PARTS of all rows are cut into slices; so there are at most
# HOT_PARTS of them and their texts add up to at most HOT_PARTS average rows.
HOT_PARTS = 400


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per input row: ``row`` (all input columns), ``keep_id``, ``group_size``, ``kept``, ``content_sha256``.

    Rows are range-partitioned by sampled splitters of (leading characters, hash, slice) and
    sorted externally by that and the whole content; a window over the sorted run compares
    neighbouring contents in full, so equal contents form one frame without another shuffle.
    A content held by a large share of all rows is cut into slices by id, which are dealt to
    several partitions; the frames of its slices are put together from one pre-aggregated row
    per content.

    ``normalise`` maps the content before comparing (default: no change). ``keep`` is
    "smallest" or "largest" id. Defined cases: a null content counts as empty; null ids lose to
    any other id, and a group with only null ids has a null ``keep_id``; of rows that repeat
    id and content exactly one is kept; an empty table gives no rows; input columns live
    inside ``row`` and so can't clash.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    content = F.coalesce(text, F.lit(""))
    base = docs.select(
        F.struct(*others).alias("rest") if others else F.lit(None).alias("rest"),
        F.col(f"`{id_col}`").alias("id"),
        content.alias("text"),
        text.isNull().alias("no_text"),
        (normalise(content) if normalise else content).alias("content"),
    ).withColumn("h", F.xxhash64("content"))

    total = docs.count()
    counts = base.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(
        counts.where(F.col("n") * HOT_PARTS >= max(total, HOT_PARTS))
        .where("n > 1")
        .select(F.col("h"), F.ceil(F.col("n") * HOT_PARTS / F.lit(max(total, 1))).cast("int").alias("slices"))
    )
    hot_groups = cut_lineage(
        base.join(F.broadcast(hot), "h")
        .groupBy("h", "content")
        .agg(best("id").alias("hot_id"), F.count(F.lit(1)).alias("hot_n"))
    )

    keyed = (
        base.join(F.broadcast(hot), "h", "left")
        .withColumn("lead", F.substring("content", 1, SPLITTER_CHARS))
        .withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slices"))).cast("int"))
        .drop("slices")
    )
    # partitioned by (lead, h, slice), the frames below need no further exchange
    run = keyed.repartitionByRange("lead", "h", "slice")
    frame = W.partitionBy("lead", "h", "slice", "content")
    first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    runs = run.select(
        "*",
        F.row_number().over(frame.orderBy(first)).alias("place"),
        best("id").over(frame).alias("own_id"),
        F.count(F.lit(1)).over(frame).alias("own_n"),
    )
    whole = runs.join(F.broadcast(hot_groups), ["h", "content"], "left")
    keep_id = F.when(F.col("hot_n").isNull(), F.col("own_id")).otherwise(F.col("hot_id"))
    inputs = [
        F.when(~F.col("no_text"), F.col("text")).alias(c) if c == text_col else F.col("rest").getField(c).alias(c)
        for c in docs.columns
    ]
    return whole.select(
        F.struct(*inputs).alias("row"),
        keep_id.alias("keep_id"),
        F.coalesce("hot_n", "own_n").alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & (F.col("place") == 1)).alias("kept"),
        F.sha2("content", 256).alias("content_sha256"),
    )
