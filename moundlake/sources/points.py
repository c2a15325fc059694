"""Point clouds: Parquet tables and uncompressed LAS files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moundlake.runtime import broadcast_aggregate, spread
from moundlake.schema import POINTS

RECORDS_PER_SPLIT = 1_000_000
POINT_COLUMNS = ["survey_id", "x", "y", "z", "classification"]


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point table in Parquet; classification 0 where a file has none."""
    df = spark.read.parquet(path)
    if "classification" not in df.columns:
        df = df.withColumn("classification", F.lit(0))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in POINTS.fields])


def within(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Points inside bounds, both ends inclusive; reaches the Parquet scan as a pushed filter."""
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def metadata(points: DataFrame) -> DataFrame:
    """Bounds, count and classification flag per survey; surveys without points do not appear."""
    extremes = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("point_count"), *extremes,
        F.bool_or(F.col("classification") > 0).alias("has_classification"),
    )


def require_points(meta: DataFrame, surveys: DataFrame) -> DataFrame:
    """All asked-for surveys with their metadata and an error for empty clouds."""
    return surveys.select("survey_id").join(meta, "survey_id", "left").withColumn(
        "error", F.when(F.col("point_count").isNull(), F.lit("point cloud is empty"))
    )


def bounds(meta: DataFrame) -> DataFrame:
    return meta.select("survey_id", "min_x", "min_y", "max_x", "max_y")


def crs_of(epsg: Column, wkt: Column) -> Column:
    """EPSG:n, else the WKT text, else NULL."""
    return F.coalesce(F.concat(F.lit("EPSG:"), epsg.cast("string")), F.nullif(wkt, F.lit("")))


def crs_compatible(a: Column, b: Column) -> Column:
    """Both known and equal."""
    return F.coalesce((a != "") & (b != "") & (a == b), F.lit(False))


def ground_probe(points: DataFrame, index: str | None = None, records: int | None = None) -> DataFrame:
    """Whether ground points occur, over all points; or among the first ``records`` of each file.

    ``index`` is the record number within the file (LAS source or Parquet row index).
    """
    probed = points if records is None else points.where(F.col(index) < records)
    return probed.groupBy("survey_id").agg(
        F.bool_or(F.col("classification") == 2).alias("has_ground"),
        F.count_if(F.col("classification") == 2).alias("ground_points"),
        F.count(F.lit(1)).alias("probed"),
    )


def bounds_audit(meta: DataFrame, headers: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Header bounds against the bounds of the points; repaired bounds where they differ."""
    names = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]
    joined = meta.join(headers.select("survey_id", *[F.col(n).alias(f"header_{n}") for n in names]), "survey_id")
    wrong = F.lit(False)
    for n in names:
        wrong = wrong | (F.abs(F.col(n) - F.col(f"header_{n}")) > tolerance)
    return joined.withColumn("needs_repair", wrong).select(
        "survey_id", "needs_repair",
        *[F.when(F.col("needs_repair"), F.col(n)).otherwise(F.col(f"header_{n}")).alias(n) for n in names],
    )


def union_points(*parts: DataFrame) -> DataFrame:
    """Chunks or groups of points as one table; missing columns become NULL."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


# ---- LAS -----------------------------------------------------------------
# User id of the CRS records, their record ids, and the keys of the coordinate system in the directory of keys.
CRS_USER, KEYS_RECORD, WKT_RECORD = b"LASF_Projection", 34735, 2112
PROJECTED_KEY, GEOGRAPHIC_KEY, USER_DEFINED = 3072, 2048, 32767

HEADERS = (
    "survey_id long, path string, version string, format int, length int, data_offset long, count long, scale array<double>, shift array<double>, "
    "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double, epsg int, wkt string, error string"
)


def parse_las_header(head: bytes) -> dict:
    """Fields of the public LAS 1.0-1.4 header block and of the CRS records after it; ``head`` reaches to the point data."""
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError("not a readable LAS file")
    header_size, = struct.unpack_from("<H", head, 94)
    offset, records, fmt, length, count = struct.unpack_from("<IIBHI", head, 96)
    if fmt & 0x80:
        raise ValueError("compressed LAS is not supported")
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", head, 179)
    if head[25] >= 4 and header_size >= 375:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    epsg = wkt = None
    at = header_size
    for _ in range(records):
        if at + 54 > len(head):
            raise ValueError("LAS records are cut off")
        user, record, size = head[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", head, at + 18)
        body = head[at + 54 : at + 54 + size]
        at += 54 + size
        if user != CRS_USER:
            continue
        if record == WKT_RECORD:
            wkt = body.rstrip(b"\0").decode("utf-8", "replace") or None
        elif record == KEYS_RECORD:
            words = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
            keys = {words[i]: words[i + 3] for i in range(4, len(words) - 3, 4) if words[i + 1] == 0}
            epsg = next((keys[k] for k in (PROJECTED_KEY, GEOGRAPHIC_KEY) if keys.get(k) not in (None, 0, USER_DEFINED)), None)
    return {
        "version": f"{head[24]}.{head[25]}", "format": fmt, "length": length, "data_offset": offset, "count": count, "scale": list(scale),
        "shift": list(shift), "min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y, "min_z": min_z, "max_z": max_z, "epsg": epsg, "wkt": wkt,
    }


def open_for_reading(path: str):
    """A file on any system that the listing names: local, object store or HDFS; used inside tasks."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path within it; Spark names local files ``file:/...``."""
    plain = path.removeprefix("file:")
    if plain != path or "://" not in path:
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(path)


def las_headers(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """One row per LAS file under ``path`` (a folder or glob): header fields, CRS records, or the error of an unreadable file.

    Spark lists the files; headers are read in tasks, a few kilobytes a file. Files are numbered by path from ``first_id`` on. Files
    without points get an error, too.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")
    numbered = listed.withColumn("survey_id", (F.row_number().over(Window.orderBy("path")) + (first_id - 1)).cast("long"))  # file names only

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for survey_id, name in zip(batch.column("survey_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                row = dict.fromkeys(arrow.names) | {"survey_id": survey_id, "path": name}
                try:
                    with open_for_reading(name) as f:
                        head = f.read(375)
                        offset = struct.unpack_from("<I", head, 96)[0] if len(head) >= 100 and head[:4] == b"LASF" else 0
                        row |= parse_las_header(head + f.read(max(offset - len(head), 0)))
                    if row["count"] == 0:
                        row["error"] = "point cloud is empty"
                except (OSError, ValueError) as problem:
                    row["error"] = str(problem)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(HEADERS))
    return spread(numbered.select("survey_id", "path")).mapInArrow(read, HEADERS)


def header_crs(headers: DataFrame) -> DataFrame:
    """``(survey_id, crs)``: EPSG:n from the directory of keys, else the WKT record, else NULL."""
    return headers.select("survey_id", crs_of(F.col("epsg"), F.col("wkt")).alias("crs"))


def read_las(spark: SparkSession, path: str, records_per_split: int = RECORDS_PER_SPLIT, first_id: int = 1) -> DataFrame:
    """Points of all LAS files under ``path``: fixed-size records, every range of ``records_per_split`` read by itself.

    The ranges come from the header table, so the driver opens no file. An unreadable file fails the read; an empty one has no points.
    """
    headers = las_headers(spark, path, first_id)
    usable = headers.withColumn("count", F.when(F.col("error").isNull() | (F.col("count") == 0), F.col("count")).otherwise(
        F.raise_error(F.concat("error", F.lit(": "), "path"))
    )).where("count > 0")
    last = F.floor((F.col("count") - 1) / records_per_split)
    ranges = usable.select(
        "survey_id", "path", "format", "length", "data_offset", "count", "scale", "shift", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.to_pylist():
                new_style = head["format"] >= 6
                kind = np.dtype({
                    "names": ["x", "y", "z", "cls"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 16 if new_style else 15], "itemsize": head["length"],
                })
                at, stop = head["k"] * records_per_split, min((head["k"] + 1) * records_per_split, head["count"])
                with open_for_reading(head["path"]) as f:
                    f.seek(head["data_offset"] + at * head["length"])
                    while at < stop:
                        n = min(100_000, stop - at)
                        rec = np.frombuffer(f.read(n * head["length"]), dtype=kind)
                        if len(rec) < n:
                            raise ValueError(f"LAS file ends early: {head['path']}")
                        xyz = [rec[a] * s + o for a, s, o in zip("xyz", head["scale"], head["shift"], strict=True)]
                        cls = rec["cls"] & (0xFF if new_style else 0x1F)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, head["survey_id"], dtype="int64")), *[pa.array(v) for v in xyz],
                                pa.array(cls.astype("int32")), pa.array(np.arange(at, at + n, dtype="int64")),
                            ],
                            names=[*POINT_COLUMNS, "point_index"],
                        )
                        at += n

    return spread(ranges).mapInArrow(read, "survey_id long, x double, y double, z double, classification int, point_index long")


def write_las(points: DataFrame, folder: str, scale: float = 0.001, epsg: int | None = None, records_per_file: int = RECORDS_PER_SPLIT) -> DataFrame:
    """Uncompressed LAS 1.2 files (format 0) of at most about ``records_per_file`` points; ``(survey_id, part, path, points)`` of what was written.

    A survey's points are dealt over as many files as they need, each written by one task; a file that is written again replaces itself.
    """
    sizes = points.groupBy("survey_id").agg(F.ceil(F.count(F.lit(1)) / records_per_file).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("x", "y", "z", "classification"), F.col("_parts")).cast("int")
    dealt = points.select(*POINT_COLUMNS).join(broadcast_aggregate(sizes), "survey_id").withColumn("part", part).drop("_parts")

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        survey, part = (k.as_py() for k in key)
        xyz = [rows.column(n).to_numpy() for n in "xyz"]
        shift = [float(np.floor(v.min())) for v in xyz]
        record = np.zeros(len(xyz[0]), np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("rest", "V2"), ("flags", "u1"), ("cls", "u1"), ("tail", "V4")]))
        for n, v, o in zip("xyz", xyz, shift, strict=True):
            record[n] = np.round((v - o) / scale).astype(np.int32)
        record["flags"], record["cls"] = 9, rows.column("classification").to_numpy()
        keys = struct.pack("<8H", 1, 1, 0, 1, PROJECTED_KEY, 0, 1, epsg) if epsg else b""
        records = struct.pack("<H16sHH32s", 0, CRS_USER, KEYS_RECORD, len(keys), b"") + keys if epsg else b""
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", b"\x01\x02"
        struct.pack_into("<H", head, 94, 227)
        struct.pack_into("<IIBHI", head, 96, 227 + len(records), int(bool(epsg)), 0, record.dtype.itemsize, len(record))
        struct.pack_into("<3d", head, 131, *[scale] * 3)
        struct.pack_into("<3d", head, 155, *shift)
        struct.pack_into("<6d", head, 179, *[f(v) for v in xyz for f in (np.max, np.min)])
        path = f"{folder}/survey-{survey:08d}-{part:05d}.las"
        system, inner = file_system(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(bytes(head) + records + record.tobytes())
        return pa.table({"survey_id": [survey], "part": pa.array([part], pa.int32()), "path": [path], "points": [len(record)]})

    return dealt.groupBy("survey_id", "part").applyInArrow(write, "survey_id long, part int, path string, points long")
