"""Approximate nearest neighbours by a forest of hash-prefix trees, kept as sorted arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moundlake.llm.common import cut_lineage

# Distinct vectors of one forest, and queries that one task searches in it.
SHARD_ROWS = 8192
QUERY_BLOCK = 2048


class Forest:
    """Trees over the rows of ``points``: for each tree the sorted hash strings and the rows in that order.

    Hash bits are signs of random projections. The largest inner product becomes the smallest
    angle by one more coordinate, which brings all points to the same length.
    """

    def __init__(self, points: np.ndarray, trees: int, bits: int, seed: int):
        self.points, self.trees, self.bits = points, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((points.shape[1] + 1, trees, bits)).astype(np.float32)
        norms = np.linalg.norm(points, axis=1)
        self.scale = norms.max()
        rest = np.sqrt(np.maximum(0, 1 - (norms / self.scale) ** 2))
        keys = self.hashes(np.column_stack([points / self.scale, rest]))
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        """``[tree, row]``: hash strings as numbers, the first bit highest."""
        out, rows = np.zeros((self.trees, len(rows)), np.int64), rows.astype(np.float32)
        for t in range(self.trees):
            signs = rows @ self.planes[:, t] > 0
            out[t] = signs @ (1 << np.arange(self.bits, dtype=np.int64)[::-1])
        return out

    def longest_prefix(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each query shares with its nearest neighbour in sorted order, at most over the trees."""
        best = np.zeros(keys.shape[1], np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.keys[t], keys[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.keys[t]) - 1)):
                differ = (self.keys[t][near] ^ keys[t]).astype(np.float64)
                best = np.maximum(best, self.bits - np.frexp(differ)[1])
        return best

    def ranges(self, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = self.bits - depth
        first = (keys >> shift) << shift
        low, high = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for t in range(self.trees):
            low[t] = np.searchsorted(self.keys[t], first[t])
            high[t] = np.searchsorted(self.keys[t], first[t] + (1 << shift))
        return low, high

    def others(self, low: np.ndarray, high: np.ndarray, own: int) -> int:
        """Distinct rows in the ranges of one query, without its own."""
        found = np.unique(np.concatenate([self.order[t, low[t] : high[t]] for t in range(self.trees)]))
        return len(found) - int(own in found)

    def candidates(self, queries: np.ndarray, wanted: int, least: int = 0, own: np.ndarray | None = None):
        """Yield the candidate rows of each query.

        All trees are descended to the longest match, then ascended together, a bit at a time,
        until their ranges hold ``wanted`` entries (a row counts once a tree) and ``least`` distinct
        rows, both without the query's own row (``own``, -1 for none), or all rows.
        """
        own = np.full(len(queries), -1) if own is None else own
        keys = self.hashes(np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))]))
        depth = self.longest_prefix(keys)
        low, high = self.ranges(keys, depth)
        open_ = np.arange(len(queries))
        while True:
            entries = (high - low).sum(axis=0)[open_] - self.trees * (own[open_] >= 0)
            short = entries < wanted
            # more entries than least - 1 rows can have need no count
            for j in np.flatnonzero(~short & (entries <= self.trees * (least - 1))):
                q = open_[j]
                short[j] = self.others(low[:, q], high[:, q], own[q]) < least
            open_ = open_[short & (depth[open_] > 0)]
            if not len(open_):
                break
            depth[open_] -= 1
            low[:, open_], high[:, open_] = self.ranges(keys[:, open_], depth[open_])
        for q in range(len(queries)):
            seen = np.zeros(len(self.points), bool)
            for t in range(self.trees):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vec, dim)`` of the rows that take part."""
    vec = F.col(f"`{vector_col}`")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"), F.size(vec).alias("dim"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    trees: int = 64, bits: int = 24, candidates: float = 1.0, seed: int = 42, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` largest inner products found, in double precision.

    Copies of a vector are indexed once, with their k + 1 smallest ids, which is all a result can
    hold. The distinct vectors are dealt by hash into shards of about ``shard_rows``; one forest
    a shard is searched by blocks of queries, so every row is indexed, a task holds one shard and
    one block, and the work grows with shards times blocks. In a shard the trees are
    ascended until their ranges hold ``candidates`` times its rows (counted with repeats
    over ``trees`` trees) and k + 1 distinct rows, both besides the query's own, or all rows; candidates are scored on the original vectors and the best of all
    shards are merged.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids; rows that repeat id and vector count once; a query never
    finds its own id; ties go to the smaller id; vectors of unequal length never meet;
    with fewer than ``k`` others all that were found are returned.
    """
    rows = usable(vectors, id_col, vector_col)
    same = W.partitionBy("dim", "vec").orderBy("vec_id")
    first_ids = rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = cut_lineage(first_ids.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = cut_lineage(usable(queries, id_col, vector_col).distinct())
    shards = max(1, -(-classes.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_block))
    points = classes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seekers = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    schema = "query_id long, vec_id long, score double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            base, ask = matrix(left.column("vec"), dim), matrix(right.column("vec"), dim)
            ids = left.column("ids").to_pylist()
            forest = Forest(base, trees, bits, seed)
            at = {v.tobytes(): i for i, v in enumerate(base)}
            own = np.array([at.get(v.tobytes(), -1) for v in ask])
            each = forest.candidates(ask, int(candidates * len(base)), k + 1, own)
            for q, found in zip(zip(right.column("vec_id").to_pylist(), ask, strict=True), each, strict=True):
                query_id, vector = q
                scores = np.einsum("ij,j->i", base[found], vector)
                if len(found) > k + 1:
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    found, scores = found[scores >= least], scores[scores >= least]
                best = sorted((-s, i) for c, s in zip(found.tolist(), scores.tolist(), strict=True) for i in ids[c] if i != query_id)[:k]
                out[0] += [query_id] * len(best)
                out[1] += [i for _, i in best]
                out[2] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["dim", "shard", "block"]
    found = points.groupBy(*keys).cogroup(seekers.groupBy(*keys)).applyInArrow(search, schema)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
