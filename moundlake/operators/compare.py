"""Match the heaps of two surveys and report what changed."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundlake.functions.rings import polygon_bounds
from moundlake.operators.graph import connected_components
from moundlake.runtime import bounded_broadcast, cut_lineage

IOU_THRESHOLD = 0.3        # fixed values: defaults of the comparison settings
STABILITY_THRESHOLD = 0.05
BLOCK = 64.0               # metres, coarse key that prunes polygon pairs
WHOLE_EDGES = 100_000      # overlaps of a comparison that one task solves as a whole
STRIP = 4.0                # metres, width of the strips in which edges of two polygons meet


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of one comparison whose bounding boxes meet.

    ``a, b(pair_id, heap_id, rings)``. Boxes are spread over coarse blocks; a pair
    is kept only in the block of the lower-left corner of its common box, so no
    duplicates are shuffled away afterwards.
    """

    def boxed(df: DataFrame, side: str) -> DataFrame:
        box = df.where("rings is not null").withColumn("b", polygon_bounds(F.col("rings")))
        span = lambda lo, hi: F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK))
        return (
            box.withColumn("bx", F.explode(span(F.col("b.min_x"), F.col("b.max_x"))))
            .withColumn("by", F.explode(span(F.col("b.min_y"), F.col("b.max_y"))))
            .select(
                "pair_id", "bx", "by",
                F.struct("heap_id", "rings", "b").alias(side),
            )
        )

    met = boxed(a, "a").join(boxed(b, "b"), ["pair_id", "bx", "by"])
    x, y = F.greatest("a.b.min_x", "b.b.min_x"), F.greatest("a.b.min_y", "b.b.min_y")
    return met.where(
        (x <= F.least("a.b.max_x", "b.b.max_x"))
        & (y <= F.least("a.b.max_y", "b.b.max_y"))
        & (F.floor(x / BLOCK) == F.col("bx"))
        & (F.floor(y / BLOCK) == F.col("by"))
    ).select(
        "pair_id",
        F.col("a.heap_id").alias("heap_a"), F.col("b.heap_id").alias("heap_b"),
        F.col("a.rings").alias("rings_a"), F.col("b.rings").alias("rings_b"),
    )


def oriented_edges(rings: Column) -> Column:
    """Edges ``(x1, y1, x2, y2, sign)`` of rings that aren't upright; outer rings count once, holes are taken off.

    Below every edge lies the strip down to a base line. With the sign of its direction, the strips of a ring that runs
    counter-clockwise add up to its inside. A ring's first edge midpoint lies in as many other rings as it is deep, which
    tells holes from outer rings whatever way they run; rings must not cross themselves.
    """
    steps = lambda ring: F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
    )
    crossed = lambda x, y, ring: F.size(F.filter(
        steps(ring), lambda e: ((e.y1 <= y) != (e.y2 <= y)) & (e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) < x)
    ))
    turn = lambda ring: F.aggregate(
        steps(ring), F.lit(0.0), lambda acc, e: acc + (e.x1 - ring[0][0]) * (e.y2 - ring[0][1]) - (e.x2 - ring[0][0]) * (e.y1 - ring[0][1])
    )

    def signed(ring: Column, k: Column) -> Column:
        x, y = (ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2
        within = F.transform(rings, lambda other, j: F.when(j == k, 0).otherwise(F.pmod(crossed(x, y, other), F.lit(2))))
        depth = F.aggregate(within, F.lit(0), lambda acc, v: acc + v)
        forward = F.when((turn(ring) > 0) == (F.pmod(depth, F.lit(2)) == 0), F.lit(1)).otherwise(F.lit(-1))
        return F.transform(F.filter(steps(ring), lambda e: e.x1 != e.x2), lambda e: F.struct(
            F.least(e.x1, e.x2).alias("x1"), F.when(e.x1 < e.x2, e.y1).otherwise(e.y2).alias("y1"),
            F.greatest(e.x1, e.x2).alias("x2"), F.when(e.x1 < e.x2, e.y2).otherwise(e.y1).alias("y2"),
            F.when(e.x1 > e.x2, forward).otherwise(-forward).alias("sign"),
        ))

    return F.flatten(F.transform(rings, signed))


def polygon_iou(pairs: DataFrame) -> DataFrame:
    """Exact intersection over union; pairs without common area are left out.

    Two polygons' common area is the sum, over an edge of each, of the signed area below both edges: the integral of
    the lower of two straight lines over the widths they share. Edges are dealt into strips of ``STRIP`` metres, so an edge meets
    those of its strip only, and every pair of polygons is one grouped sum. No polygon is held in one task.
    """
    known = pairs.where("rings_a is not null and rings_b is not null").select(
        "pair_id", "heap_a", "heap_b", oriented_edges(F.col("rings_a")).alias("ea"), oriented_edges(F.col("rings_b")).alias("eb"),
        F.floor(F.least(F.array_min(F.transform(F.flatten("rings_a"), lambda p: p[1])), F.array_min(F.transform(F.flatten("rings_b"), lambda p: p[1])))).alias("low"),
        F.floor(F.flatten("rings_a")[0][0]).alias("west"),
    )
    known = cut_lineage(known)
    keys = ["pair_id", "heap_a", "heap_b"]

    def strips(side: str) -> DataFrame:
        """Edges cut at the strips they pass, relative to a corner of the pair."""
        edges = known.select(*keys, "low", "west", F.explode(side).alias("e")).select(
            *keys, (F.col("e.x1") - F.col("west")).alias("x1"), (F.col("e.y1") - F.col("low")).alias("y1"),
            (F.col("e.x2") - F.col("west")).alias("x2"), (F.col("e.y2") - F.col("low")).alias("y2"), F.col("e.sign").alias("sign"),
        )
        within = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.col("x1") / STRIP), F.floor(F.col("x2") / STRIP))))
        lo, hi = F.greatest(F.col("x1"), F.col("strip") * STRIP), F.least(F.col("x2"), (F.col("strip") + 1) * STRIP)
        at = lambda x: F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
        cut = within.select(*keys, "strip", lo.alias("lo"), hi.alias("hi"), at(lo).alias("p"), at(hi).alias("q"), "sign").where("lo < hi")
        return cut.select(*keys, "strip", F.struct("lo", "hi", "p", "q", "sign").alias(side))

    def area(side: str) -> DataFrame:
        return strips(side).groupBy(*keys).agg(F.sum(F.expr(f"{side}.sign * ({side}.hi - {side}.lo) * ({side}.p + {side}.q) / 2")).alias(f"area_{side}"))

    met = strips("ea").join(strips("eb"), [*keys, "strip"])
    lo, hi = F.greatest("ea.lo", "eb.lo"), F.least("ea.hi", "eb.hi")
    line = lambda e, x: F.col(f"{e}.p") + (x - F.col(f"{e}.lo")) * (F.col(f"{e}.q") - F.col(f"{e}.p")) / (F.col(f"{e}.hi") - F.col(f"{e}.lo"))
    ends = met.where(lo < hi).select(
        *keys, (hi - lo).alias("width"), (F.col("ea.sign") * F.col("eb.sign")).alias("sign"), line("eb", lo).alias("bp"), line("eb", hi).alias("bq"),
        (line("ea", lo) - line("eb", lo)).alias("dp"), (line("ea", hi) - line("eb", hi)).alias("dq"),
    )
    dp, dq = F.col("dp"), F.col("dq")
    under = (
        F.when((dp >= 0) & (dq >= 0), F.lit(0.0)).when((dp <= 0) & (dq <= 0), (dp + dq) / 2)
        .when(dp < 0, dp * dp / (dp - dq) / 2).otherwise(dq * dq / (dq - dp) / 2)
    )
    common = ends.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("width") * ((F.col("bp") + F.col("bq")) / 2 + under)).alias("common"))
    return (
        common.join(area("ea"), keys).join(area("eb"), keys)
        .withColumn("iou", F.col("common") / (F.col("area_ea") + F.col("area_eb") - F.col("common")))
        # areas are sums of terms that cancel: less than a square millimetre is no overlap
        .where("common > 1e-6").select(*keys, "iou")
    )


def raster_iou(cells_a: DataFrame, cells_b: DataFrame) -> DataFrame:
    """IoU of labelled cells: ``cells(pair_id, r, c, heap_id)``; counts only, no geometry."""
    size = lambda df, name: df.groupBy("pair_id", F.col("heap_id").alias(name)).agg(
        F.count(F.lit(1)).alias(f"n_{name}")
    )
    common = (
        cells_a.withColumnRenamed("heap_id", "heap_a")
        .join(cells_b.withColumnRenamed("heap_id", "heap_b"), ["pair_id", "r", "c"])
        .groupBy("pair_id", "heap_a", "heap_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        common.join(size(cells_a, "heap_a"), ["pair_id", "heap_a"])
        .join(size(cells_b, "heap_b"), ["pair_id", "heap_b"])
        .select(
            "pair_id", "heap_a", "heap_b",
            (F.col("n") / (F.col("n_heap_a") + F.col("n_heap_b") - F.col("n"))).alias("iou"),
        )
    )


def best_assignment(edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Pairs of greatest total weight, by shortest augmenting paths on the sparse edges.

    Every left node also has a private partner of weight 0, so none must be matched.
    """
    edges = sorted(edges)
    lefts, rights = sorted({a for a, _, _ in edges}), sorted({b for _, b, _ in edges})
    n, m = len(lefts), len(rights)
    left, right = {a: i for i, a in enumerate(lefts)}, {b: j for j, b in enumerate(rights)}
    graph: list[list[tuple[int, float]]] = [[] for _ in lefts]
    for a, b, w in edges:
        graph[left[a]].append((right[b], -w))
    for i, out in enumerate(graph):
        out.append((m + i, 0.0))  # the private partner
    u, v = [min(c for _, c in out) for out in graph], [0.0] * (m + n)
    owner, mate = [-1] * (m + n), [-1] * n
    far = float("inf")
    for start in range(n):
        dist: dict[int, float] = {}
        parent: dict[int, int] = {}
        done: dict[int, float] = {}
        queue: list[tuple[float, int, int]] = []
        # the search ends at the nearest free partner, so what lies no nearer than one that is known is left out
        node, base, count, free = start, 0.0, 0, far
        while True:
            own = u[node]
            for b, cost in graph[node]:
                d = base + cost - own - v[b]
                if d < free and b not in done and d < dist.get(b, far) - 1e-15:
                    dist[b], parent[b] = d, node
                    count += 1
                    heapq.heappush(queue, (d, count, b))
                    if owner[b] < 0:
                        free = d
            while True:
                d, _, b = heapq.heappop(queue)
                if b not in done and d <= dist[b]:
                    break
            done[b] = d
            if owner[b] < 0:
                break
            node, base = owner[b], d
        # raise the potentials of the scanned nodes, then flip the path
        u[start] += d
        for k, dk in done.items():
            if k != b and owner[k] >= 0:
                u[owner[k]] += d - dk
                v[k] -= d - dk
        while True:
            a = parent[b]
            owner[b] = a
            mate[a], b = b, mate[a]
            if a == start:
                break
    return sorted((lefts[owner[b]], rights[b]) for b in range(m) if owner[b] >= 0)


def assign(iou: DataFrame, threshold: float = IOU_THRESHOLD, whole_edges: int = WHOLE_EDGES) -> DataFrame:
    """Optimal one-to-one assignment: (pair_id, heap_a, heap_b, iou) with iou >= threshold.

    The overlap graph falls apart into components, and the optimum of the whole is
    the union of their optima. An isolated pair is its own optimum and never leaves the JVM; a
    comparison of at most ``whole_edges`` other overlaps is solved as a whole, which visits its components one by one.
    Only larger comparisons are taken apart by the distributed loop.
    """
    # one integer per heap: A on even, B on odd numbers
    edges = iou.select(
        "pair_id", (F.col("heap_a") * 2).alias("a"), (F.col("heap_b") * 2 + 1).alias("b"), "heap_a", "heap_b", "iou"
    )
    degree = lambda k: edges.groupBy("pair_id", k).agg(F.count(F.lit(1)).alias(f"deg_{k}"))
    known = edges.join(degree("a"), ["pair_id", "a"]).join(degree("b"), ["pair_id", "b"])
    lone = known.where("deg_a = 1 and deg_b = 1").select("pair_id", "heap_a", "heap_b", "iou")
    tangled = known.where("deg_a > 1 or deg_b > 1")
    if tangled.isEmpty():
        return lone.where(F.col("iou") >= threshold)

    def solve(rows: pa.Table) -> pa.Table:
        a, b = rows.column("heap_a").to_pylist(), rows.column("heap_b").to_pylist()
        chosen = set(best_assignment(list(zip(a, b, rows.column("iou").to_pylist(), strict=True))))
        return rows.select(["pair_id", "heap_a", "heap_b", "iou"]).filter(pa.array([pair in chosen for pair in zip(a, b, strict=True)]))

    schema = "pair_id long, heap_a long, heap_b long, iou double"
    columns = [F.col("pair_id").cast("long").alias("pair_id"), "heap_a", "heap_b", "iou"]
    large = cut_lineage(tangled.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_edges).select("pair_id"))
    if large.isEmpty():
        return lone.unionByName(tangled.select(*columns).groupBy("pair_id").applyInArrow(solve, schema)).where(F.col("iou") >= threshold)
    few = bounded_broadcast(large)
    apart = cut_lineage(tangled.join(few, "pair_id", "left_semi"))
    roots = connected_components(apart.select("pair_id", "a", "b"), "pair_id").select("pair_id", F.col("node").alias("a"), "root")
    solved = tangled.join(few, "pair_id", "left_anti").select(*columns).groupBy("pair_id").applyInArrow(solve, schema).unionByName(
        apart.join(roots, ["pair_id", "a"]).select(*columns, "root").groupBy("pair_id", "root").applyInArrow(solve, schema)
    )
    return lone.unionByName(solved).where(F.col("iou") >= threshold)


def match_state(delta: Column, percent: Column, stability: float = STABILITY_THRESHOLD) -> Column:
    return (
        F.when(F.abs(percent) / 100 < stability, F.lit("unchanged"))
        .when(delta > 0, F.lit("grown"))
        .otherwise(F.lit("decreased"))
    )


def describe_matches(matches: DataFrame, a: DataFrame, b: DataFrame, stability: float = STABILITY_THRESHOLD) -> DataFrame:
    """Matched pairs with rounded differences and their state."""
    side = lambda df, s: df.select(
        "pair_id", F.col("heap_id").alias(f"heap_{s}"), F.col("volume_m3").alias(f"volume_{s}"),
        F.col("planimetric_area_m2").alias(f"area_{s}"), F.col("max_height_m").alias(f"height_{s}"),
    )
    joined = matches.join(side(a, "a"), ["pair_id", "heap_a"]).join(side(b, "b"), ["pair_id", "heap_b"])
    delta = F.col("volume_b") - F.col("volume_a")
    percent = F.when(F.col("volume_a") > 0, delta / F.col("volume_a") * 100).otherwise(F.lit(0.0))
    return joined.select(
        "pair_id", "heap_a", "heap_b", F.round("iou", 4).alias("iou"),
        match_state(delta, percent, stability).alias("state"),
        F.round(delta, 3).alias("delta_volume"),
        F.round(F.col("area_b") - F.col("area_a"), 3).alias("delta_planimetric_area"),
        F.round(F.col("height_b") - F.col("height_a"), 3).alias("delta_max_height"),
        F.round(percent, 2).alias("delta_volume_percent"),
    )


def mark_ambiguous(described: DataFrame, iou: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Other heaps that overlap either side at or above the threshold make a match ambiguous."""
    strong = iou.where(F.col("iou") >= threshold)
    others = lambda key, other: (
        described.select("pair_id", key, F.col(other).alias("_mine"))
        .join(strong.select("pair_id", key, F.col(other).alias("_other")), ["pair_id", key])
        .where("_other <> _mine")
        .groupBy("pair_id", key)
        .agg(F.array_sort(F.collect_set("_other")).alias(f"{key}_others"))
    )
    joined = described.join(others("heap_a", "heap_b"), ["pair_id", "heap_a"], "left").join(
        others("heap_b", "heap_a"), ["pair_id", "heap_b"], "left"
    )
    none = F.array().cast("array<bigint>")
    return joined.select(
        *[c for c in described.columns if c != "state"],
        F.when(
            F.col("heap_a_others").isNotNull() | F.col("heap_b_others").isNotNull(), F.lit("ambiguous")
        ).otherwise(F.col("state")).alias("state"),
        F.coalesce("heap_a_others", none).alias("a_candidates"),
        F.coalesce("heap_b_others", none).alias("b_candidates"),
    )


def unmatched(matches: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed heaps (only in A) and added heaps (only in B)."""
    removed = a.join(matches.select("pair_id", F.col("heap_a").alias("heap_id")), ["pair_id", "heap_id"], "left_anti")
    added = b.join(matches.select("pair_id", F.col("heap_b").alias("heap_id")), ["pair_id", "heap_id"], "left_anti")
    return removed, added


def change_table(matched: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Matched, removed and added heaps as one table with a state per row."""
    none = F.lit(None)
    return (
        matched.select("pair_id", "heap_a", "heap_b", "state", "delta_volume")
        .unionByName(
            removed.select(
                "pair_id", F.col("heap_id").alias("heap_a"), none.cast("long").alias("heap_b"),
                F.lit("removed").alias("state"), (-F.col("volume_m3")).alias("delta_volume"),
            )
        )
        .unionByName(
            added.select(
                "pair_id", none.cast("long").alias("heap_a"), F.col("heap_id").alias("heap_b"),
                F.lit("added").alias("state"), F.col("volume_m3").alias("delta_volume"),
            )
        )
    )


def match_summary(changes: DataFrame, a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per state and volume totals for every requested pair, also with an empty side.

    The total adds the rounded differences of the matched heaps.
    """
    total = lambda df, s: df.groupBy("pair_id").agg(
        F.sum("volume_m3").alias(f"volume_{s}"), F.count(F.lit(1)).alias(f"n_{s}")
    )
    states = ("unchanged", "grown", "decreased", "added", "removed", "ambiguous")
    counted = changes.groupBy("pair_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in states],
        F.sum("delta_volume").alias("delta"),
    )
    joined = (
        pairs.select("pair_id")
        .join(total(a, "a"), "pair_id", "left").join(total(b, "b"), "pair_id", "left")
        .join(counted, "pair_id", "left")
        .na.fill(0)
    )
    percent = (
        F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), F.lit(0.0))
        .when(F.col("n_a") == 0, F.lit(100.0))
        .when(F.col("n_b") == 0, F.lit(-100.0))
        .when(F.col("volume_a") > 0, F.col("delta") / F.col("volume_a") * 100)
        .otherwise(F.lit(0.0))
    )
    return joined.select(
        "pair_id", *states,
        F.round("delta", 3).alias("total_delta_volume"),
        F.round(percent, 2).alias("total_delta_volume_percent"),
        F.round("volume_a", 3).alias("volume_a"), F.round("volume_b", 3).alias("volume_b"),
    )


def delta_cells(height_a: DataFrame, height_b: DataFrame) -> DataFrame:
    """Height difference B - A per cell; a cell known on one side only counts as zero on the other."""
    return height_a.withColumnRenamed("v", "va").join(
        height_b.withColumnRenamed("v", "vb"), ["pair_id", "r", "c"], "full_outer"
    ).select(
        "pair_id", "r", "c",
        F.round(F.coalesce("vb", F.lit(0.0)) - F.coalesce("va", F.lit(0.0)), 6).alias("v"),
    )


def regrid(cells: DataFrame, factor: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Block mean on a coarser grid."""
    return cells.groupBy(
        *keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")
    ).agg(F.round(F.avg("v"), 6).alias("v"))
