"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. Two rows whose angles to a direction are ``a`` and ``b`` enclose an angle
between ``|a - b|`` and ``min(a + b, 2 pi - a - b)``; over all directions that gives an interval of cosines and, times both
norms, bounds of their score. Only where these bounds, widened beyond any rounding, overlap a window that still counts is
the whole-number score computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moundlake.llm.common import cut_lineage

# Rows of a block and anchors of a block on average: a block of rows is searched with one block of anchors at a time.
ROWS, ANCHORS = 16_384, 2_048
# Reference directions at most; each is a row of the input.
DIRECTIONS = 16
# Components become whole numbers of this many steps a unit.
STEPS = 256
# Angles and norms are off by less than this share; far above double rounding, far below what filters.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(vec_id, label, q)`` of the rows with an id, a label and whole finite vectors; ``q`` are the stepped components."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite)
    return kept.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * STEPS).cast("double")).alias("q"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def angles_to(q: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """``[row, direction]``; a row of zeros has any angle, which doesn't matter as its scores are 0."""
    cosines = (q @ directions.T) / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def score_bounds(angle: np.ndarray, norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, rounded outward to whole numbers, of one row's scores with many, from their stored angles."""
    least = np.zeros(len(angles)) if not angles.shape[1] else np.abs(angles - angle).max(axis=1)
    both = angles + angle
    most = np.full(len(angles), np.pi) if not angles.shape[1] else np.minimum(both, 2 * np.pi - both).min(axis=1)
    # arccos loses half the digits next to 0 and pi, so angles are widened by the root of the slack
    wide = np.sqrt(SLACK)
    high, low = np.cos(np.maximum(least - wide, 0)), np.cos(np.minimum(most + wide, np.pi))
    size = norms * norm
    edge = size * SLACK + 1
    return np.floor(size * low - edge), np.ceil(size * high + edge)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def searched(rows: DataFrame, anchors: DataFrame, work, schema: str, totals: tuple[int, int]) -> DataFrame:
    """``work`` over every block of rows with every block of anchors: the stated query set against all rows.

    A block of rows is copied once for each ``ANCHORS`` anchors, and anchors to every block of rows.
    """
    sides = [max(1, -(-n // per)) for n, per in zip(totals, (ROWS, ANCHORS), strict=True)]
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(sides[0])).cast("long").alias("block"), other(sides[1]).alias("part"))
    right = anchors.select("*", F.pmod(F.xxhash64("anchor_id"), F.lit(sides[1])).cast("long").alias("to_part"), other(sides[0]).alias("to_block"))
    return left.groupBy("block", "part").cogroup(right.groupBy("to_block", "to_part")).applyInArrow(work, schema)


class Block:
    """The rows of a block by dimension, with their stored angles and norms."""

    def __init__(self, rows: pa.Table):
        sizes = np.array([len(v) for v in rows.column("q")], np.int64)
        self.by_width = {}
        for width in np.unique(sizes).tolist():
            part = rows.filter(pa.array(sizes == width))
            self.by_width[width] = (
                part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("q"), width),
                part.column("norm").to_numpy(), matrix(part.column("angles"), len(part.column("angles")[0])),
            )


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, directions: int = DIRECTIONS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows where ``anchor`` (over ``vec_id``) holds.

    A score is the inner product of two rows' components in whole steps of 1/256, rounded down. Positives are the first rows of
    the anchor's label other than itself, negatives of a positive the first rows of other labels whose score lies between
    ``low_percent`` and ``high_percent`` of the positive's. Higher scores come first, ties by smaller id.

    Defined cases: rows with a null id, label or vector, with null or non-finite components or without any take no
    part; rows of another dimension than the anchor's never meet it; zero vectors take part with scores of 0; rows that repeat
    an id are rows of their own but never positives of an anchor of that id; ids repeated among the best are listed
    as often; further columns are left behind, whatever their names; very long vectors are compared whole; an
    empty table gives no rows.
    """
    kept = usable(vectors, id_col, vector_col, label if label is not None else F.col("label"))
    kept = cut_lineage(kept)
    total = kept.count()
    # a few rows a dimension, the same on every run; any directions give the same results
    chosen = (
        kept.where(F.exists("q", lambda x: x != 0)).select(F.size("q").alias("width"), F.xxhash64("vec_id").alias("draw"), "vec_id", "q")
        .withColumn("at", F.row_number().over(W.partitionBy("width").orderBy("draw", "vec_id", "q"))).where(F.col("at") <= directions)
    )
    if kept.select(F.size("q").alias("w")).distinct().limit(33).count() > 32:
        chosen = chosen.limit(0)  # no directions at all: every score is computed
    reference: dict[int, np.ndarray] = {}
    for row in chosen.select("width", "q").toLocalIterator():  # 32 dimensions of 16 rows at most
        reference.setdefault(row["width"], []).append(np.array(row["q"]))
    reference = {w: np.array([v / np.linalg.norm(v) for v in vs]) for w, vs in reference.items()}

    def measured(batches):
        for batch in batches:
            norms, angles = [], []
            for q in batch.column("q"):
                v = q.values.to_numpy(zero_copy_only=False)
                norms.append(float(np.sqrt(v @ v)))
                angles.append(angles_to(v[None], np.array(norms[-1:]), reference.get(len(v), np.zeros((0, len(v)))))[0])
            kinds = {"norm": pa.array(norms, pa.float64()), "angles": pa.array(angles, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *kinds.values()], [*batch.schema.names, *kinds])

    rows = cut_lineage(kept.mapInArrow(measured, "vec_id long, label long, q array<double>, norm double, angles array<double>"))
    anchors = rows.where(anchor).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("q").alias("a"), F.col("norm").alias("a_norm"), F.col("angles").alias("a_angles")
    )
    # rows that repeat an anchor's id are one anchor if they are equal
    anchors = cut_lineage(anchors.dropDuplicates(["anchor_id", "own", "a"]).withColumn("number", F.monotonically_increasing_id()))
    totals = (total, anchors.count())

    def each_anchor(block: Block, asked: pa.Table):
        for i in range(asked.num_rows):
            a = asked.column("a")[i].values.to_numpy(zero_copy_only=False)
            if len(a) in block.by_width:
                ids, labels, q, norms, angles = block.by_width[len(a)]
                low, high = score_bounds(asked.column("a_angles")[i].values.to_numpy(zero_copy_only=False), asked.column("a_norm")[i].as_py(), angles, norms)
                yield i, a, ids, labels, q, low, high

    def same_label(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"number": [], "positive_id": [], "positive_score": []}
        owns, names, numbers = (asked.column(c).to_pylist() for c in ("own", "anchor_id", "number"))
        for i, a, ids, labels, q, low, high in each_anchor(Block(block), asked):
            at = np.flatnonzero((labels == owns[i]) & (ids != names[i]))
            if len(at) > positives:  # the k-th best lower bound is reached by k rows
                at = at[high[at] >= np.partition(low[at], len(at) - positives)[len(at) - positives]]
            scores = (q[at] @ a).astype(np.int64)
            first = best(scores, ids[at], positives)
            out["number"] += [numbers[i]] * len(first)
            out["positive_id"] += ids[at][first].tolist()
            out["positive_score"] += scores[first].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    near = searched(rows, anchors, same_label, "number long, positive_id long, positive_score long", totals)
    order = W.partitionBy("number").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = near.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("near"))  # a handful
    asking = cut_lineage(anchors.join(windows, "number"))

    def other_labels(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"number": [], "place": [], "negative_id": [], "negative_score": []}
        owns, numbers, wanted = (asked.column(c).to_pylist() for c in ("own", "number", "near"))
        for i, a, ids, labels, q, low, high in each_anchor(Block(block), asked):
            differs, reach = labels != owns[i], np.zeros(len(ids), bool)
            for p in wanted[i]:
                reach |= (100 * high >= low_percent * p["positive_score"]) & (100 * low <= high_percent * p["positive_score"])
            at = np.flatnonzero(differs & reach)
            scores = (q[at] @ a).astype(np.int64)
            for p in wanted[i]:
                fits = np.flatnonzero((100 * scores >= low_percent * p["positive_score"]) & (100 * scores <= high_percent * p["positive_score"]))
                first = fits[best(scores[fits], ids[at][fits], negatives)]
                out["number"] += [numbers[i]] * len(first)
                out["place"] += [p["place"]] * len(first)
                out["negative_id"] += ids[at][first].tolist()
                out["negative_score"] += scores[first].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = searched(rows, asking, other_labels, "number long, place long, negative_id long, negative_score long", totals)
    order = W.partitionBy("number", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = asking.select("number", "anchor_id", F.explode("near").alias("p")).select(
        "number", "anchor_id", F.col("p.place").cast("long").alias("place"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")
    )
    return pairs.join(found, ["number", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """The same rows in DuckDB SQL: every anchor against every row."""
    return """
    WITH kept AS MATERIALIZED (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
    scored AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM kept a JOIN kept b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
    near AS (
      SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM near JOIN scored USING (anchor_id, own)
    WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= 5
    """
