"""Text formats of reports and exports, and the colour tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category colours in project order, and the colour of heaps without one.
CATEGORY_COLOURS = [
    "#ef4444", "#f97316", "#f59e0b", "#eab308", "#84cc16", "#22c55e",
    "#14b8a6", "#06b6d4", "#3b82f6", "#8b5cf6", "#a855f7", "#ec4899",
]
UNCLASSIFIED_COLOUR = "#6b7280"

# Label and colour of the comparison states.
STATE_LABELS = {
    "unchanged": ("Invariato", "#9ca3af"),
    "grown": ("Cresciuto", "#ef4444"),
    "decreased": ("Diminuito", "#3b82f6"),
    "added": ("Nuovo", "#22c55e"),
    "removed": ("Rimosso", "#4b5563"),
    "ambiguous": ("Ambiguo", "#f97316"),
}


def italian_number(value: Column, decimals: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def italian_date(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def italian_datetime(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy HH:mm")


def fixed(value: Column, decimals: int) -> Column:
    """Fixed decimals with a point."""
    return F.format_string(f"%.{decimals}f", value)


def percent_text(share: Column, gate: float = 3.0) -> Column:
    """Share (0-100) as text, empty up to the gate."""
    return F.when(share > gate, F.format_string("%.1f%%", share)).otherwise(F.lit(""))


def confidence_text(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def category_colours(heaps: DataFrame, projects: DataFrame) -> DataFrame:
    """Colour of each heap by the position of its category in the project's list."""
    palette = F.array(*[F.lit(c) for c in CATEGORY_COLOURS])
    listed = projects.select("project_id", F.posexplode("material_categories").alias("_pos", "material_category"))
    # a name listed twice takes its first position
    first = listed.groupBy("project_id", "material_category").agg(F.min("_pos").alias("_pos"))
    position = F.col("_pos") % len(CATEGORY_COLOURS)
    return heaps.join(first, ["project_id", "material_category"], "left").withColumn(
        "colour", F.when(F.col("_pos").isNotNull(), palette[position]).otherwise(F.lit(UNCLASSIFIED_COLOUR))
    ).drop("_pos")


def state_labels(changes: DataFrame) -> DataFrame:
    """Label and colour of each state, from a six-row table."""
    rows = [(state, label, colour) for state, (label, colour) in STATE_LABELS.items()]
    lookup = changes.sparkSession.createDataFrame(rows, "state string, state_label string, state_colour string")
    return changes.join(F.broadcast(lookup), "state", "left")
