"""Declared schemas: nothing in the library relies on inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


I, L, D, S, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

POINTS = _struct(survey_id=L, x=D, y=D, z=D, classification=I)
GRIDS = _struct(survey_id=L, west=D, north=D, res=D, width=I, height=I, crs=S)
CELLS = _struct(survey_id=L, r=I, c=I, v=D)
LABELS = _struct(survey_id=L, r=I, c=I, heap_id=L)
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(D)))
GEOMETRY = _struct(type=S, coordinates=RINGS)

HEAP_METRICS = _struct(
    heap_id=L, polygon_geojson=S, volume_m3=D, planimetric_area_m2=D, surface_area_m2=D,
    max_height_m=D, mean_height_m=D, base_elevation_m=D, centroid_e=D, centroid_n=D,
    bbox_min_e=D, bbox_min_n=D, bbox_max_e=D, bbox_max_n=D,
)

RESULTS_DOCUMENT = _struct(
    survey_metadata=T.MapType(S, S),
    heap_metrics=T.ArrayType(HEAP_METRICS),
    base_elevation=D,
    base_elevation_method=S,
    base_elevation_confidence=D,
    intermediate_files=T.MapType(S, S),
    warnings=T.ArrayType(S),
)

CONFIG = _struct(
    dsm_resolution=D, height_threshold=D, min_heap_area=D, max_heap_area=D, base_percentile=D,
    morpho_kernel_size=I, precomputed_dsm_path=S, ground_classification_opening_m=D,
    use_ground_classification=B, manual_base_elevation=D,
)

# The defaults a survey gets when its configuration leaves a field out.
CONFIG_DEFAULTS = {
    "dsm_resolution": 0.10,
    "height_threshold": 0.5,
    "min_heap_area": 50.0,
    "max_heap_area": 50000.0,
    "base_percentile": 5.0,
    "morpho_kernel_size": 50,
    "precomputed_dsm_path": None,
    "ground_classification_opening_m": 150.0,
    "use_ground_classification": True,
    "manual_base_elevation": None,
}

MESSAGE = _struct(type=S, phase=S, percent=D, message=S, code=S)


def with_missing_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that an older table does not have yet."""
    defaults = defaults or {}
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
    return df
