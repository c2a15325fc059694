"""Results documents, configurations, section lines and input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundlake.schema import CONFIG, CONFIG_DEFAULTS, RESULTS_DOCUMENT


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results documents, one multi-line JSON file per survey."""
    return spark.read.schema(RESULTS_DOCUMENT).option("multiLine", "true").json(path)


def result_heaps(documents: DataFrame) -> DataFrame:
    """Heap rows of results documents."""
    return documents.select("survey_id", F.explode("heap_metrics").alias("h")).select("survey_id", "h.*")


def parse_results(texts: DataFrame) -> DataFrame:
    """``(survey_id, document)`` JSON text to typed documents."""
    return texts.select("survey_id", F.from_json("document", RESULTS_DOCUMENT).alias("d")).select("survey_id", "d.*")


# JSON types that each type of setting accepts; null stands for the default.
ACCEPTED = {
    "double": "^(BIGINT|DOUBLE|DECIMAL.*|VOID)$", "integer": "^(BIGINT|VOID)$", "boolean": "^(BOOLEAN|VOID)$", "string": "^(STRING|VOID)$",
}


def parse_config(texts: DataFrame) -> DataFrame:
    """``(survey_id, config)`` text to typed settings with defaults.

    Unknown keys are ignored; empty text means all defaults; text that is not a
    JSON object, or a value of the wrong type, gives an error row that names the field.
    """
    blank = F.col("config").isNull() | (F.trim("config") == "")
    parsed = F.from_json(F.when(~blank, F.col("config")), CONFIG, {"mode": "PERMISSIVE"})
    valid = blank | (F.get_json_object("config", "$").isNotNull() & F.trim("config").startswith("{"))
    given = F.try_parse_json("config")
    wrong = F.array_compact(F.array(*[
        F.when(~F.regexp_like(F.schema_of_variant(F.try_variant_get(given, f"$.{f.name}", "variant")), F.lit(ACCEPTED[f.dataType.typeName()])), F.lit(f.name))
        for f in CONFIG.fields
    ]))
    rows = texts.withColumn("_p", parsed).withColumn(
        "error",
        F.when(~valid, F.lit("invalid JSON configuration")).when(
            ~blank & (F.size(wrong) > 0), F.concat(F.lit("wrong type: "), F.array_join(wrong, ", "))
        ),
    )
    fields = [
        F.when(
            F.col("error").isNull(),
            F.coalesce(F.col(f"_p.{f.name}"), F.lit(CONFIG_DEFAULTS[f.name]).cast(f.dataType)),
        ).alias(f.name)
        for f in CONFIG.fields
    ]
    return rows.select("survey_id", *fields, "error")


def parse_line(text: Column) -> Column:
    """Section line from GeoJSON LineString, JSON array of points, or ``x1,y1;x2,y2``."""
    points = "array<array<double>>"
    trimmed = F.trim(text)
    pairs = F.transform(
        F.split(trimmed, ";"), lambda s: F.transform(F.split(s, ","), lambda v: F.trim(v).cast("double"))
    )
    return (
        F.when(trimmed.startswith("{"), F.from_json(F.get_json_object(trimmed, "$.coordinates"), points))
        .when(trimmed.startswith("["), F.from_json(trimmed, points))
        .otherwise(pairs)
    )


def input_errors(inputs: DataFrame) -> DataFrame:
    """Problems of each survey's inputs as an array (empty when usable).

    Columns: survey_id, las_path, tiff_path (NULL when missing), las_crs, tiff_crs,
    las_* and tiff_* bounds.
    """
    missing = F.col("las_path").isNull() | F.col("tiff_path").isNull()
    no_crs = lambda c: F.col(c).isNull() | (F.col(c) == "")
    disjoint = (
        (F.col("las_max_x") < F.col("tiff_min_x")) | (F.col("las_min_x") > F.col("tiff_max_x"))
        | (F.col("las_max_y") < F.col("tiff_min_y")) | (F.col("las_min_y") > F.col("tiff_max_y"))
    )
    mismatch = ~no_crs("las_crs") & ~no_crs("tiff_crs") & (F.col("las_crs") != F.col("tiff_crs"))
    return inputs.select(
        "survey_id",
        F.array_compact(
            F.array(
                F.when(F.col("las_path").isNull(), F.lit("point cloud not found")),
                F.when(F.col("tiff_path").isNull(), F.lit("orthophoto not found")),
                F.when(~missing & no_crs("las_crs"), F.lit("point cloud without CRS")),
                F.when(~missing & no_crs("tiff_crs"), F.lit("orthophoto without CRS")),
                F.when(
                    ~missing & mismatch,
                    F.concat(F.lit("CRS mismatch: "), F.col("las_crs"), F.lit(" / "), F.col("tiff_crs")),
                ),
                F.when(~missing & disjoint, F.lit("no spatial overlap")),
            )
        ).alias("errors"),
    )


# Error codes.
CORRUPT_LAS = "CORRUPT_LAS"
MISSING_CRS = "MISSING_CRS"


def las_error_code(message: Column, from_reader: Column) -> Column:
    """Code of a point-cloud loading error."""
    low = F.lower(message)
    unreadable = from_reader | low.contains("too small") | low.contains("magic")
    no_crs = (low.contains("crs") & low.contains("not")) | low.contains("no crs")
    return F.when(unreadable, F.lit(CORRUPT_LAS)).when(no_crs, F.lit(MISSING_CRS)).otherwise(F.lit(CORRUPT_LAS))


def tiff_error_code(message: Column) -> Column:
    """Code and detail of an orthophoto loading error."""
    detail = F.when(F.lower(message).contains("crs"), F.lit("no valid CRS")).otherwise(
        F.concat(F.lit("invalid raster: "), message)
    )
    return F.struct(F.lit(MISSING_CRS).alias("code"), detail.alias("detail"))
