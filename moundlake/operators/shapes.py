"""Vector output: outlines of heaps, simplification, repair, split and merge.

Outlines are linked and ordered by Spark joins. Simplification, repair, split and merge work on the polygons of an Arrow
batch at once, by NumPy steps over flat arrays, never on cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundlake.functions import flat
from moundlake.functions.rings import parse_geometry, polygon_area
from moundlake.runtime import bounded_broadcast, cut_lineage, spread
from moundlake.schema import RINGS

RINGS_DDL = "array<array<array<double>>>"


def outline_segments(labels: DataFrame) -> DataFrame:
    """Straight boundary segments in grid vertices (i down, j right), inside on the left.

    A cell side is boundary when the neighbour across it has another label. Sides
    in one line are merged into runs before anything leaves the JVM.
    """
    row = Window.partitionBy("survey_id", "r").orderBy("c")
    col = Window.partitionBy("survey_id", "c").orderBy("r")

    def open_side(line, along: str, step: int):
        other = F.lag(F.struct(F.col(along).alias("at"), F.col("heap_id").alias("label")), step).over(line)
        return ~F.coalesce((other["at"] == F.col(along) - step) & (other["label"] == F.col("heap_id")), F.lit(False))

    flagged = (
        labels.withColumn("_west", open_side(row, "c", 1))
        .withColumn("_east", open_side(row, "c", -1))
        .withColumn("_north", open_side(col, "r", 1))
        .withColumn("_south", open_side(col, "r", -1))
    )
    side = lambda flag, name, line, along: F.when(
        F.col(flag), F.struct(F.lit(name).alias("side"), line.alias("line"), along.alias("along"))
    )
    sides = flagged.select(
        "survey_id", "heap_id",
        F.explode(
            F.array_compact(
                F.array(
                    side("_north", "n", F.col("r"), F.col("c")),
                    side("_south", "s", F.col("r") + 1, F.col("c")),
                    side("_west", "w", F.col("c"), F.col("r")),
                    side("_east", "e", F.col("c") + 1, F.col("r")),
                )
            )
        ).alias("k"),
    ).select("survey_id", "heap_id", "k.*")
    keys = ["survey_id", "heap_id", "side", "line"]
    island = F.col("along") - F.row_number().over(Window.partitionBy(*keys).orderBy("along"))
    return (
        sides.withColumn("_g", island).groupBy(*keys, "_g")
        .agg(F.min("along").alias("a"), (F.max("along") + 1).alias("b")).drop("_g")
    )


def directed_segments(labels: DataFrame) -> DataFrame:
    """Boundary segments with their first and last grid vertex (``x`` right, ``i`` down) and a number.

    A side and the vertex it starts from belong to one cell only, so the number is unique within a survey.
    """
    k, line = F.col("side"), F.col("line")
    south, north = k == "s", k == "n"
    turns = {"s": 0, "e": 1, "n": 2, "w": 3}  # counter-clockwise: each is a left turn from the one before
    code = F.when(south, turns["s"]).when(k == "e", turns["e"]).when(north, turns["n"]).otherwise(turns["w"])
    ends = outline_segments(labels).select(
        "survey_id", "heap_id", code.alias("turn"),
        F.when(south, F.col("a")).when(north, F.col("b")).otherwise(line).alias("x1"),
        F.when(south | north, line).when(k == "e", F.col("b")).otherwise(F.col("a")).alias("i1"),
        F.when(south, F.col("b")).when(north, F.col("a")).otherwise(line).alias("x2"),
        F.when(south | north, line).when(k == "e", F.col("a")).otherwise(F.col("b")).alias("i2"),
    )
    number = (F.shiftleft(F.col("i1").cast("long"), 33) + F.shiftleft(F.col("x1").cast("long"), 2) + F.col("turn")).alias("id")
    return ends.select("survey_id", "heap_id", number, "turn", "x1", "i1", "x2", "i2")


def next_segments(segments: DataFrame) -> DataFrame:
    """``segments`` with the number of the ``next`` one of their ring.

    Where two cells touch at a corner two segments start; the left turn stays at the same cell, so their rings stay apart.
    """
    starts = segments.select("survey_id", "heap_id", F.col("x1").alias("x2"), F.col("i1").alias("i2"), F.col("id").alias("to"), F.col("turn").alias("then"))
    left = F.pmod(F.col("then") - F.col("turn"), F.lit(4)) != 1
    followed = segments.join(starts, ["survey_id", "heap_id", "x2", "i2"]).where("then <> turn and to <> id")
    chosen = followed.groupBy("survey_id", "id").agg(F.min_by("to", left).alias("next"))
    return segments.join(chosen, ["survey_id", "id"])


def rank_rings(links: DataFrame) -> DataFrame:
    """``(survey_id, id, ring, ahead)`` of ``(survey_id, id, next)``: the least number of the ring and the steps ahead to it.

    List ranking by pointer doubling: after k rounds a row knows the least of the 2^k segments from it on. When no row's least
    changes any more, every window holds its ring's least. Rounds grow with the logarithm of the longest ring.
    """
    known = cut_lineage(links.select("survey_id", "id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("ahead")))
    width = 1
    while True:
        other = known.select("survey_id", F.col("id").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"), F.col("ahead").alias("_ahead"))
        nearer = F.col("low") <= F.col("_low")
        joined = known.join(other, ["survey_id", "next"]).select(
            "survey_id", "id", F.col("_next").alias("next"), F.least("low", "_low").alias("low"),
            F.when(nearer, F.col("ahead")).otherwise(F.col("_ahead") + width).alias("ahead"), (~nearer).alias("moved"),
        )
        known = cut_lineage(joined)
        width *= 2
        if known.where("moved").isEmpty():
            return known.select("survey_id", "id", F.col("low").alias("ring"), "ahead")


def outlines(labels: DataFrame, grids: DataFrame) -> DataFrame:
    """Exact cell outline of every label: (survey_id, heap_id, rings), outer rings counter-clockwise and first, holes clockwise.

    Boundary segments are linked to rings by joins and put in order by list ranking; only the ring itself, which is
    one value of the result, is gathered in one place.
    """
    segments = cut_lineage(next_segments(directed_segments(labels)))
    ranked = segments.join(rank_rings(segments), ["survey_id", "id"])
    geometry = bounded_broadcast(grids.select("survey_id", "west", "north", "res"))
    # the segment after the ring's least one has the longest way ahead
    place = F.when(F.col("ahead") == 0, F.lit(0)).otherwise(-F.col("ahead"))
    order = F.struct((F.col("ahead") > 0).alias("later"), place.alias("place"), F.array(
        F.col("west") + F.col("x1") * F.col("res"), F.col("north") - F.col("i1") * F.col("res")
    ).alias("p"))
    twice = F.sum(F.col("x2").cast("long") * F.col("i1") - F.col("x1").cast("long") * F.col("i2"))
    rings = ranked.join(geometry, "survey_id").groupBy("survey_id", "heap_id", "ring").agg(
        F.array_sort(F.collect_list(order)).alias("o"), twice.alias("area2")
    ).select("survey_id", "heap_id", F.struct((-F.col("area2")).alias("a"), "ring", F.concat(F.col("o.p"), F.array(F.col("o.p")[0])).alias("pts")).alias("k"))
    return rings.groupBy("survey_id", "heap_id").agg(F.array_sort(F.collect_list("k")).alias("k")).select(
        "survey_id", "heap_id", F.col("k.pts").alias("rings")
    )


def _map_rings(df: DataFrame, change: Callable[[flat.Flat, pa.RecordBatch], flat.Flat]) -> DataFrame:
    """``change(rings, batch)`` on the ``rings`` column, all polygons of a batch at once; NULL where no ring is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, batch.schema.get_field_index("rings")
            rings, corner = flat.localise(flat.decode(batch.column(at)), n)
            changed = flat.moved(change(rings, batch), corner)
            column = flat.encode(changed, changed.owner, n, np.bincount(changed.owner, minlength=n) == 0)
            yield pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    # NULL polygons can come out, whatever the input column promised
    kinds = [T.StructField(f.name, RINGS if f.name == "rings" else f.dataType, True) for f in df.schema.fields]
    return spread(df).mapInArrow(run, T.StructType(kinds))


def simplify(polygons: DataFrame) -> DataFrame:
    """Douglas-Peucker per ring with the row's ``tolerance``, before any union of parts."""

    def change(rings: flat.Flat, batch: pa.RecordBatch) -> flat.Flat:
        return flat.simplify(rings, batch.column("tolerance").to_numpy(zero_copy_only=False).astype(float))

    return _map_rings(polygons, change)


def repair(polygons: DataFrame, largest_only: bool = False) -> DataFrame:
    """Even-odd repair of crossing rings; degenerate polygons become NULL."""

    def change(rings: flat.Flat, batch: pa.RecordBatch) -> flat.Flat:
        parts = flat.merged(rings, np.zeros(len(rings.owner), dtype=np.int64), batch.num_rows)
        if not largest_only:
            return parts
        row = np.flatnonzero(flat.changes(parts.owner, parts.part))
        area = np.add.reduceat(flat.areas(parts), row) if len(row) else np.zeros(0)
        best = np.lexsort((-area, parts.owner[row]))
        best = row[best[flat.changes(parts.owner[row[best]])]] if len(row) else row
        largest = np.full(batch.num_rows, -1)
        largest[parts.owner[best]] = parts.part[best]
        return parts.take(np.flatnonzero(parts.part == largest[parts.owner]))

    return _map_rings(polygons, change)


def split(polygons: DataFrame) -> DataFrame:
    """Parts of each polygon cut by its ``line``: keys, part, rings, error.

    Error rows: the line is not a LineString (NULL), does not meet the polygon, or
    does not cut it into two parts.
    """
    keys = [n for n in polygons.columns if n not in ("rings", "line")]
    schema = ", ".join(f"{n} {polygons.schema[n].dataType.simpleString()}" for n in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rings, corner = flat.localise(flat.decode(batch.column("rings")), n)
            lines = batch.column("line")
            length = pc.list_value_length(lines).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            points = lines.flatten()
            at = flat.starts(pc.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64))
            values, line_of = points.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), length)
            line = np.column_stack([values[at], values[at + 1]]) - corner[line_of]
            cut = length[line_of] >= 2
            parts, meets = flat.split(rings, line[cut], line_of[cut], n)
            number = np.bincount(parts.owner[flat.changes(parts.owner, parts.part)], minlength=n) if len(parts.owner) else np.zeros(n, dtype=np.int64)
            whole = (length >= 2) & meets & (number >= 2)
            parts = flat.moved(parts.take(np.flatnonzero(whole[parts.owner])), corner)
            # a row for every part, or one with the error
            rows = np.where(whole, number, 1)
            row, good = np.repeat(np.arange(n), rows), np.repeat(whole, rows)
            part = flat.runs(np.ones(n, dtype=np.int64), rows)
            out_of = flat.starts(rows)[parts.owner] + parts.part
            error = np.where(length < 2, "cutter is not a LineString", np.where(meets, "line does not cut the polygon into 2 parts", "line does not intersect the polygon"))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k).take(pa.array(row)) for k in keys], pa.array(part.astype(np.int32), mask=~good),
                flat.encode(parts, out_of, len(row), ~good), pa.array(error[row], mask=good, type=pa.string()),
            ], [*keys, "part", "rings", "error"])

    return spread(polygons).mapInArrow(run, f"{schema}, part int, rings {RINGS_DDL}, error string")


def merge(members: DataFrame, group: str = "merge_id") -> DataFrame:
    """Union per merge group: group, members, rings, error (fewer than two polygons).

    A group is the handful of polygons that become one polygon value.
    """
    kind = members.schema[group].dataType.simpleString()
    # dealt by a fixed number, as by spread(); the groups need no further exchange
    dealt = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    grouped = dealt.groupBy(group).agg(F.collect_list("rings").alias("shapes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shapes = batch.num_rows, batch.column("shapes")
            size = pc.list_value_length(shapes).to_numpy(zero_copy_only=False).astype(np.int64)
            rings = flat.decode(shapes.flatten())
            member = rings.owner
            rings, corner = flat.localise(rings._replace(owner=np.repeat(np.arange(n), size)[member]), n)
            several = np.flatnonzero(size[rings.owner] >= 2)
            united = flat.moved(flat.merged(rings.take(several), member[several], n), corner)
            error = np.full(n, "merge needs at least 2 polygons", dtype=object)
            yield pa.RecordBatch.from_arrays([
                batch.column(group), pa.array(size.astype(np.int32)), flat.encode(united, united.owner, n, size < 2),
                pa.array(error, mask=size >= 2, type=pa.string()),
            ], [group, "members", "rings", "error"])

    return grouped.mapInArrow(run, f"{group} {kind}, members int, rings {RINGS_DDL}, error string")


def decode_geometries(df: DataFrame, text: str = "polygon_geojson") -> DataFrame:
    """GeoJSON text to ``rings`` (all parts under one even-odd rule); NULL when it is no polygon."""
    return df.withColumn("rings", F.flatten(parse_geometry(F.col(text))))


def with_area(df: DataFrame) -> DataFrame:
    return df.withColumn("area_m2", polygon_area(F.col("rings")))
