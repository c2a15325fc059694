"""Split a heap with several tops along its valleys, as a graph job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundlake.operators import neighbourhood as nb
from moundlake.operators.graph import connected_components
from moundlake.runtime import bounded_broadcast, cut_lineage


def peaks(labels: DataFrame, height: DataFrame, grids: DataFrame, distance: int = 10) -> DataFrame:
    """Peaks of every heap: cells that lead their (2d+1) x (2d+1) box within the heap.

    Equal heights are ordered by position (lowest row, then column, leads), so two
    peaks are never closer than the distance. Each heap is seen alone: its cells
    offer their value to the box rows and columns they reach, grouped by heap.
    """
    value = F.struct(F.col("v").alias("v"), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"))
    cells = labels.join(height, ["survey_id", "r", "c"]).withColumn("key", value)
    line = Window.partitionBy("survey_id", "heap_id", "r").orderBy("c").rangeBetween(-distance, distance)
    across = cells.withColumn("_row_best", F.max("key").over(line))
    # the best of a box = the best of the row bests; a row best is carried to the columns within reach
    reach = F.explode(F.sequence(F.col("c") - distance, F.col("c") + distance)).alias("bc")
    spread = across.select("survey_id", "heap_id", "r", reach, "key").groupBy("survey_id", "heap_id", "r", "bc").agg(
        F.max("key").alias("_row_best")
    )
    column = Window.partitionBy("survey_id", "heap_id", "bc").orderBy("r").rangeBetween(-distance, distance)
    boxes = spread.withColumn("_best", F.max("_row_best").over(column)).select(
        "survey_id", "heap_id", "r", F.col("bc").alias("c"), "_best"
    )
    geometry = bounded_broadcast(grids.select("survey_id", "width", "height"))
    return (
        cells.join(boxes, ["survey_id", "heap_id", "r", "c"])
        .where("_best = key and v > 0")
        .join(geometry, "survey_id")
        .where(
            (F.col("r") >= distance) & (F.col("c") >= distance)
            & (F.col("r") < F.col("height") - distance) & (F.col("c") < F.col("width") - distance)
        )
        .select("survey_id", "heap_id", "r", "c", "v")
    )


def split_heaps(labels: DataFrame, height: DataFrame, grids: DataFrame, distance: int = 10) -> DataFrame:
    """Labels after splitting every heap with two or more peaks; other heaps keep theirs.

    Same parts as flooding the inverted heap from its peaks, but as graph steps:
    every cell climbs to its highest 4-neighbour, which gives one basin per local
    top; basins without a peak join the neighbour across their highest pass, round
    by round; the passes then say through which cell every cell is reached first.
    Each step is a component search on a distributed edge table. New ids follow the
    survey's largest id, in the order of (heap, row, column) of the peak.
    """
    found = cut_lineage(peaks(labels, height, grids, distance))
    many = found.groupBy("survey_id", "heap_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("survey_id", "heap_id")
    if many.isEmpty():
        return labels
    geometry = bounded_broadcast(grids.select("survey_id", "width"))
    cells = cut_lineage(
        labels.join(many, ["survey_id", "heap_id"], "left_semi")
        .join(height, ["survey_id", "r", "c"])
        .join(geometry, "survey_id")
        .select("survey_id", "heap_id", "r", "c", "v", (F.col("r").cast("long") * F.col("width") + F.col("c")).alias("id"))
    )
    me = F.struct(F.col("v").alias("v"), (-F.col("id")).alias("n"))

    def beside(keys: list[str], along: str, step: int):
        line = Window.partitionBy("survey_id", "heap_id", *keys).orderBy(along)
        other = F.lag(F.struct(F.col(along).alias("at"), me.alias("key")), step).over(line)
        return F.when(other["at"] == F.col(along) - step, other["key"])

    around = (
        cells.withColumn("_w", beside(["r"], "c", 1)).withColumn("_e", beside(["r"], "c", -1))
        .withColumn("_n", beside(["c"], "r", 1)).withColumn("_s", beside(["c"], "r", -1))
    )
    climb = around.withColumn("_up", F.array_max(F.array(me, F.col("_w"), F.col("_e"), F.col("_n"), F.col("_s"))))
    basins = connected_components(climb.select("survey_id", F.col("id").alias("a"), (-F.col("_up.n")).alias("b")))
    owned = cut_lineage(cells.join(basins.withColumnRenamed("node", "id"), ["survey_id", "id"]))
    # passes between basins: the highest of the lower cells of all touching pairs
    touching = cut_lineage(
        around.select("survey_id", "id", me.alias("mine"), F.explode(F.array_compact(F.array(F.col("_e"), F.col("_s")))).alias("k"))
        .select("survey_id", "id", (-F.col("k.n")).alias("other"), F.least("mine", "k").alias("pass"))
        .join(owned.select("survey_id", "id", F.col("root").alias("ra")), ["survey_id", "id"])
        .join(owned.select("survey_id", F.col("id").alias("other"), F.col("root").alias("rb")), ["survey_id", "other"])
        .where("ra <> rb")
        .groupBy("survey_id", F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
        .agg(F.max("pass").alias("pass"))
    )
    tops = found.join(geometry, "survey_id").select(
        "survey_id", (F.col("r").cast("long") * F.col("width") + F.col("c")).alias("id")
    )
    state = cut_lineage(
        owned.select("survey_id", "root").distinct()
        .join(
            owned.join(tops, ["survey_id", "id"], "left_semi").select("survey_id", "root", F.col("id").alias("peak")),
            ["survey_id", "root"], "left",
        )
        .select(
            "survey_id", F.col("root").alias("basin"), F.col("root").alias("comp"), "peak",
            F.lit(None).cast("struct<v:double,n:bigint>").alias("level"),
        )
    )
    while True:  # every round joins basins, so it ends
        comps = state.select("survey_id", "basin", "comp")
        done = state.where("peak is not null").select("survey_id", "comp").distinct()
        passes = (
            touching.join(comps.select("survey_id", F.col("basin").alias("x"), F.col("comp").alias("cx")), ["survey_id", "x"])
            .join(comps.select("survey_id", F.col("basin").alias("y"), F.col("comp").alias("cy")), ["survey_id", "y"])
            .where("cx <> cy")
        )
        both = passes.select("survey_id", F.col("cx").alias("comp"), F.col("cy").alias("to"), "pass", "x", "y").union(
            passes.select("survey_id", "cy", "cx", "pass", "x", "y")
        )
        # one total order of passes, so that the choices never form a cycle
        choice = F.struct("pass", (-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"))
        chosen = both.join(done, ["survey_id", "comp"], "left_anti").groupBy("survey_id", "comp").agg(
            F.max_by("to", choice).alias("to"), F.max("pass").alias("_pass")
        )
        chosen = cut_lineage(chosen)
        if chosen.isEmpty():
            break
        joined = connected_components(chosen.select("survey_id", F.col("comp").alias("a"), F.col("to").alias("b")))
        # a basin fills up to the lowest of the passes on its way to a peak
        lowered = state.join(chosen.select("survey_id", "comp", "_pass"), ["survey_id", "comp"], "left").withColumn(
            "level", F.least("level", "_pass")
        ).drop("_pass")
        renamed = lowered.join(
            joined.withColumnRenamed("node", "comp"), ["survey_id", "comp"], "left"
        ).withColumn("comp", F.coalesce("root", "comp")).drop("root")
        known = renamed.groupBy("survey_id", "comp").agg(F.min("peak").alias("peak"))
        state = cut_lineage(renamed.drop("peak").join(known, ["survey_id", "comp"]))
    highest = labels.groupBy("survey_id").agg(F.max("heap_id").alias("_max"))
    per_heap = found.join(many, ["survey_id", "heap_id"], "left_semi").groupBy("survey_id", "heap_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("survey_id").orderBy("heap_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_heap.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("survey_id", "heap_id").orderBy("r", "c"))
    numbers = (
        found.join(offsets, ["survey_id", "heap_id"]).join(highest, "survey_id").join(geometry, "survey_id")
        .select(
            "survey_id", (F.col("r").cast("long") * F.col("width") + F.col("c")).alias("peak"),
            (F.col("_max") + F.col("_offset") + inside).alias("part_id"),
        )
    )
    # flood order: a cell above the level of its basin is reached through that pass; any
    # other cell joins the neighbour that is reached first, the one with the highest level
    levels = state.select("survey_id", F.col("basin").alias("root"), "level")
    marked = tops.withColumn("is_top", F.lit(True))
    reached = (
        owned.join(levels, ["survey_id", "root"]).join(marked, ["survey_id", "id"], "left")
        .withColumn("key", F.least(me, F.col("level")))
    )

    def reached_beside(keys: list[str], along: str, step: int):
        line = Window.partitionBy("survey_id", "heap_id", *keys).orderBy(along)
        other = F.lag(F.struct(F.col(along).alias("at"), "key", "id"), step).over(line)
        return F.when(other["at"] == F.col(along) - step, F.struct(other["key"].alias("key"), other["id"].alias("id")))

    neighbours = F.array_compact(
        F.array(
            reached_beside(["r"], "c", 1), reached_beside(["r"], "c", -1),
            reached_beside(["c"], "r", 1), reached_beside(["c"], "r", -1),
        )
    )
    linked = reached.withColumn("_first", F.array_max(neighbours)["id"]).select(
        "survey_id", F.col("id").alias("a"),
        F.when(F.col("is_top"), F.col("id")).when(me > F.col("level"), -F.col("level.n")).otherwise(F.col("_first")).alias("b"),
    )
    trees = connected_components(linked)
    owners = trees.join(tops.withColumnRenamed("id", "node"), ["survey_id", "node"], "left_semi").select(
        "survey_id", "root", F.col("node").alias("peak")
    )
    parts = (
        cells.join(trees.withColumnRenamed("node", "id"), ["survey_id", "id"])
        .join(owners, ["survey_id", "root"])
        .join(numbers, ["survey_id", "peak"])
        .select("survey_id", "r", "c", F.col("part_id").alias("heap_id"))
    )
    return labels.join(many, ["survey_id", "heap_id"], "left_anti").select("survey_id", "r", "c", "heap_id").unionByName(parts)
