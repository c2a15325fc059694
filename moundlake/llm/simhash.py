"""Near duplicates by SimHash, found with the generalised pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moundlake.llm.common import clean_texts, cut_lineage, in_batches
from moundlake.operators.graph import connected_components

BITS = 64
SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Bits of a partition that its histogram of values keeps; 2**HISTOGRAM_BITS counts each.
HISTOGRAM_BITS = 12
# An index bucket of more fingerprints is linked through shared neighbours instead of pairs.
DENSE_BUCKET = 256
# Words hashed at a time, which bounds the memory for one very long text.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; without words 0."""
    low = text.lower()
    stream = iter(low.split()) if len(low) < (4 << 20) else (m.group() for m in WORD.finditer(low))
    votes, total, tail = np.zeros(BITS, np.int64), 0, []
    while block := list(islice(stream, CHUNK)):
        block = tail + block
        tail = block[-(words - 1):] if words > 1 else []
        shingles = [b" ".join(s) for s in zip(*(block[i:] for i in range(words)), strict=False)]
        total += len(shingles)
        votes += vote(shingles)
    if not total and tail:
        total, votes = 1, vote([b" ".join(tail)])
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big") if total else 0


def vote(shingles: list[bytes]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; ``fp`` is the fingerprint as a signed long. A null text counts as empty."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "fp": np.array(found, dtype=np.uint64).view(np.int64)}

    rows = clean_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return in_batches(rows, work, "doc_id long, fp long")


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all distinct fingerprints, from summed counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).astype(">u8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        counts = np.append(both[np.triu_indices(BITS)], n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["at", "c"])

    summed = fps.select("fp").mapInArrow(work, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(BITS * (BITS + 1) // 2 + 1)
    for row in summed:  # 2,081 rows at any size
        counts[row["at"]] = row["c"]
    n = max(counts[-1], 1)
    both = np.zeros((BITS, BITS))
    both[np.triu_indices(BITS)] = counts[:-1]
    both = np.maximum(both, both.T) / n
    share = both.diagonal()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs(both - np.outer(share, share)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits (0 is the highest) into ``parts`` groups; correlated bits go together.

    Bits that say the same thing twice then share a partition, and the partitions are as
    independent of each other as they can be.
    """
    left, groups = set(range(len(correlation))), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        seed = max(left, key=lambda b: (sum(correlation[b][x] for x in left if x != b), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            nearest = max(left, key=lambda b: (sum(correlation[b][x] for x in group), -b))
            group.append(nearest)
            left.discard(nearest)
        groups.append(group)
    return groups


class Plan:
    """Partitions of the bits and, per partition, the cost of every threshold for every coarse value."""

    def __init__(self, groups: list[list[int]], histograms: list[np.ndarray], radius: int):
        self.groups, self.radius = groups, radius
        self.masks = [sum(1 << (BITS - 1 - b) for b in g) for g in groups]
        self.coarse = [g[:HISTOGRAM_BITS] for g in groups]
        self.histograms = histograms
        self.costs = [self.cost_table(len(g), len(c), h) for g, c, h in zip(groups, self.coarse, histograms, strict=True)]

    def cost_table(self, width: int, kept: int, histogram: np.ndarray) -> np.ndarray:
        """``[threshold + 1, value]``: probes plus estimated candidates, as if the other bits were even."""
        values, rest = np.arange(1 << kept), width - kept
        at = []  # fingerprints at exactly j flips of the kept bits
        for j in range(min(self.radius, kept) + 1):
            flips = [sum(1 << b for b in c) for c in combinations(range(kept), j)]
            at.append(sum(histogram[values ^ f] for f in flips))
        rows = [np.zeros(1 << kept)]
        for e in range(self.radius + 1):
            near = sum(a * sum(comb(rest, k) for k in range(e - j + 1)) for j, a in enumerate(at[: e + 1]))
            rows.append(sum(comb(width, k) for k in range(e + 1)) + near / 2.0**rest)
        return np.array(rows)

    def mean_cost(self) -> float:
        """Cost of the best thresholds for an average fingerprint."""
        means = [(c * h).sum(axis=1, keepdims=True) / max(h.sum(), 1) for c, h in zip(self.costs, self.histograms, strict=True)]
        return float(allocate(means, self.radius)[1][0])

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        costs = [c[:, pack(fps, g)] for c, g in zip(self.costs, self.coarse, strict=True)]
        return allocate(costs, self.radius)[0]


def pack(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(np.int64) << k
    return out


def allocate(costs: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least total cost, by dynamic programming over the partitions.

    Two fingerprints within ``radius`` differ by at most t_i in some partition i when the
    thresholds (-1 leaves a partition out) add up to ``radius - parts + 1``. ``costs[i]`` is
    ``[threshold + 1, query]``. Shifted by one, the thresholds are 0..radius+1 and add up to radius + 1.
    """
    parts, n = len(costs), costs[0].shape[1]
    best = np.full((radius + 2, n), np.inf)
    best[0] = 0
    took = []
    for cost in costs:
        after, choice = np.full((radius + 2, n), np.inf), np.zeros((radius + 2, n), np.int8)
        for total in range(radius + 2):
            for e in range(total + 1):
                price = best[total - e] + cost[e]
                better = price < after[total]
                after[total][better], choice[total][better] = price[better], e
        best = after
        took.append(choice)
    at, out = np.full(n, radius + 1), np.zeros((parts, n), np.int64)
    for i in reversed(range(parts)):
        out[i] = took[i][at, np.arange(n)]
        at = at - out[i]
    return out - 1, best[radius + 1]


def flips_of(bits: list[int], most: int) -> np.ndarray:
    return np.array(
        [sum(1 << (BITS - 1 - b) for b in c) for k in range(most + 1) for c in combinations(bits, k)], dtype=np.uint64
    )


def make_plan(fps: DataFrame, radius: int, parts: tuple[int, ...]) -> Plan:
    """Of the partition numbers in ``parts`` the one with the least estimated cost, from counts over all fingerprints."""
    correlation = bit_correlation(fps)
    choices = [group_bits(correlation, p) for p in parts]
    coarse = [
        F.struct(
            F.lit(k).alias("k"), F.lit(i).alias("i"),
            sum((F.shiftleft(F.shiftrightunsigned("fp", BITS - 1 - b).bitwiseAND(F.lit(1)), j) for j, b in enumerate(g[:HISTOGRAM_BITS])), F.lit(0)).alias("v"),
        )
        for k, groups in enumerate(choices) for i, g in enumerate(groups)
    ]
    counted = fps.select(F.explode(F.array(*coarse)).alias("x")).groupBy("x.k", "x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    histograms = [[np.zeros(1 << min(HISTOGRAM_BITS, len(g))) for g in groups] for groups in choices]
    for row in counted.collect():  # at most 4,096 rows a partition
        histograms[row["k"]][row["i"]][row["v"]] = row["n"]
    return min((Plan(g, h, radius) for g, h in zip(choices, histograms, strict=True)), key=Plan.mean_cost)


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """``(part, key, fp)``: the index keys every fingerprint looks up, within its own thresholds."""
    flips = [[flips_of(g, e) for e in range(plan.radius + 1)] for g in plan.groups]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        chosen = plan.thresholds(values)
        for i, mask in enumerate(plan.masks):
            for e in range(plan.radius + 1):
                own = values[chosen[i] == e]
                if len(own):
                    keys = ((own & np.uint64(mask))[:, None] ^ flips[i][e][None, :]).ravel()
                    yield {
                        "part": np.full(len(keys), i, np.int32), "key": keys.view(np.int64),
                        "fp": np.repeat(own, len(flips[i][e])).view(np.int64),
                    }

    return in_batches(fps.select("fp"), work, "part int, key long, fp long", max_bytes=1 << 19)


def links(fps: DataFrame, radius: int = 2, parts: tuple[int, ...] = (2, 3), dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """``(a, b)``: enough pairs of distinct fingerprints within ``radius`` bits to give every component.

    Every pair within the radius meets in a probed bucket and is verified on all bits. Where a
    bucket holds more than ``dense_bucket`` fingerprints, its members and all who probe it are
    linked through the points within ``radius / 2`` bits of them instead: two fingerprints are
    within an even radius exactly if they share such a point, and one star a point gives
    the same components without the pairs of the bucket.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius is an even number of bits")
    plan = make_plan(fps, radius, parts)
    index = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(plan.masks)
    ))).alias("x")).select("x.part", "x.key", F.col("fp").alias("other"))
    dense = cut_lineage(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense_bucket).select("part", "key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    crowded = dense.count() > 0
    asked = cut_lineage(probes(fps, plan)) if crowded else probes(fps, plan)
    sparse = asked.join(dense, ["part", "key"], "left_anti") if crowded else asked
    pairs = (
        sparse.join(index, ["part", "key"]).where(near & (F.col("fp") != F.col("other")))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    if not crowded:
        return pairs.distinct()
    inside = index.join(dense, ["part", "key"], "left_semi").select(F.col("other").alias("fp"))
    outside = asked.join(dense, ["part", "key"], "left_semi").select("fp")
    reach = flips_of(list(range(BITS)), radius // 2).view(np.int64).tolist()
    around = inside.union(outside).distinct().select(
        "fp", F.explode(F.transform(F.array(*map(F.lit, reach)), lambda f: F.col("fp").bitwiseXOR(f))).alias("point")
    )
    # at most 1 + 64 (for radius 2) distinct fingerprints lie around one point
    star = around.select("fp", F.min("fp").over(W.partitionBy("point")).alias("hub")).where("fp <> hub")
    return pairs.union(star.select(F.col("hub").alias("a"), F.col("fp").alias("b"))).distinct()


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
    parts: tuple[int, ...] = (2, 3), dense_bucket: int = DENSE_BUCKET,
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row; the id is the smallest reachable over linked fingerprints.

    Rows with equal fingerprints are linked and are worked on as one: only distinct
    fingerprints are indexed. Defined cases: null or empty texts have fingerprint 0; null
    ids never name a component, one of null ids only has a null id; repeated rows come back
    as often as they went in; an empty table gives no rows.
    """
    found = cut_lineage(fingerprints(docs, id_col, text_col, words))
    fps = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    edges = links(fps, radius, parts, dense_bucket).select(F.lit(0).alias("part"), "a", "b")
    roots = connected_components(edges, "part").select(F.col("node").alias("fp"), "root")
    members = roots.join(fps, "fp")
    named = members.join(members.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    naming = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return found.join(cut_lineage(naming), "fp").select("doc_id", "fp", "component_id")


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, parts: tuple[int, ...] = (2, 3),
    dense_bucket: int = DENSE_BUCKET,
) -> DataFrame:
    """``docs`` without the near copies: of each group the document with the least id stays.

    Rows that repeat an id stay or go together, and stay if one of them stands for its group; rows
    with a null id can't be named by a group and stay.
    """
    groups = near_groups(docs, id_col, text_col, words, radius, parts, dense_bucket)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    return docs.join(gone.select(F.col("doc_id").alias("gone id")), F.col(f"`{id_col}`") == F.col("gone id"), "left_anti")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
