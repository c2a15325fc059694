"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by their document frequency, the rarest first. Items travel in bundles from owner to owner: at every
stage the bundles of a shard of documents meet the postings that the stage's owner has there, in a
cogroup, and go on with one sparse accumulator of integer scores per item. After a stage the k-th best score so
far of every item bounds its final k-th best from below, so accumulators that can't get there with all later terms are
left out: results are exact at any number of stages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moundlake.llm.common import clean_texts, cut_lineage, in_batches
from moundlake.runtime import bounded_broadcast

# Shares of the documents that a term of an owner stands in at most; the last owner has all the others.
OWNERS = (0.001, 0.01, 0.1)
# Items of a bundle and documents of a shard at most.
BUNDLE, SHARD = 256, 1 << 15
# Item terms up to this number go along with the scan of the documents, so that others aren't sent; beyond it a join drops them.
FILTER_TERMS = 500_000
# Bytes split into terms at a time, which bounds the memory for one very long text.
CHUNK = 4 << 20

# A-Z become a-z, other ASCII bytes that aren't letters or digits become spaces; bytes of longer characters stay.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def count_terms(text: bytes) -> Counter:
    """Times of every term of a whole text."""
    counts, at = Counter(), 0
    while at < len(text):
        stop = min(at + CHUNK, len(text))
        while stop < len(text) and PLAIN[text[stop]] != 32:
            stop += 1
        counts.update(text[at:stop].translate(PLAIN).split(b" "))
        at = stop
    counts.pop(b"", None)
    return counts


def key_of(term: bytes) -> int:
    """The 64-bit number that stands for a term."""
    value = xxhash.xxh64_intdigest(term)
    return value - (1 << 64) if value >> 63 else value


def postings(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """``(doc_id, n, keys, times)`` of every text: all its terms counted, and the wanted ones (all, if None) with their times."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": batch.column("doc_id"), "n": [], "keys": [], "times": []}
        for text in batch.column("text").to_pylist():
            counts = count_terms(text)
            out["n"].append(counts.total())
            met = counts if wanted is None else [t for t in counts if t in wanted]
            out["keys"].append(np.fromiter(map(key_of, met), np.int64, len(met)))
            out["times"].append(np.fromiter((counts[t] for t in met), np.int64, len(met)))
        yield out

    return in_batches(docs, work, "doc_id long, n long, keys array<long>, times array<long>", max_bytes=8 << 20)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, term, key, repeats)``: the distinct terms of every item; ``item`` numbers the rows."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"item": [], "item_id": [], "term": [], "key": [], "repeats": []}
        for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
            for term, repeats in count_terms(text).items():
                for name, value in zip(out, (item, item_id, term, key_of(term), repeats), strict=True):
                    out[name].append(value)
        yield out

    rows = items.select(
        F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")
    ).withColumn("item", F.monotonically_increasing_id())
    return in_batches(rows, work, "item long, item_id long, term binary, key long, repeats long")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division; both sides are at least 0."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def impact(times: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 12 * penalty)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by ascending id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return [values.values.to_numpy(zero_copy_only=False) for values in column]


def as_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind.value_type))


NO_ID = np.iinfo(np.int64).max
BUNDLE_SCHEMA = "bundle long, shard long, item long, item_id long, floor long, keys array<long>, weights array<long>, stages array<int>, tops array<long>, rows array<int>, scores array<long>, best array<long>, best_ids array<long>"


def owner_stage(bundles: DataFrame, owned: DataFrame, stage: int, k: int) -> DataFrame:
    """Bundles after the owner of ``stage``: its contributions added, hopeless accumulators left out.

    ``best`` are the k highest scores of the shard so far with the ids of their documents.
    """

    arrow = to_arrow_schema(StructType.fromDDL(BUNDLE_SCHEMA))

    def work(items: pa.Table, posts: pa.Table) -> pa.Table:
        numbers = posts.column("row").to_numpy()
        width = int(numbers.max()) + 1 if len(numbers) else 0
        ids, penalty = np.full(width, NO_ID), np.zeros(width, np.int64)
        ids[numbers] = posts.column("doc_id").fill_null(NO_ID).to_numpy()
        penalty[numbers] = posts.column("m").to_numpy()
        lists, times = posts.column("keys").combine_chunks(), posts.column("times").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()) if len(numbers) else np.zeros(0, np.int64)
        keys, times = lists.flatten().to_numpy(), times.flatten().to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, times, holders = keys[order], times[order], np.repeat(numbers, lengths)[order]
        given = impact(times, penalty[holders])
        names = ("keys", "weights", "stages", "tops", "rows", "scores")
        lists, floors = {n: pieces(items.column(n)) for n in names}, items.column("floor").to_pylist()
        sums, out = np.zeros(width, np.int64), {n: [] for n in ("rows", "scores", "best", "best_ids")}
        for i in range(items.num_rows):
            own_keys, weights, stages, tops, rows, scores = (lists[n][i] for n in names)
            rest = int((weights * tops)[stages > stage].sum())
            sums[:] = 0
            sums[rows] = scores
            for key, weight in zip(own_keys[stages == stage], weights[stages == stage], strict=True):
                a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                sums[holders[a:b]] += weight * given[a:b]
            found = np.flatnonzero(sums)
            best = found[best_rows(sums[found], ids[found], k)]
            # the k-th best of a shard, too, is a bound of the k-th best of all
            floors[i] = max(floors[i], int(sums[best[-1]]) if len(best) == k else 0)
            found = found[sums[found] + rest >= floors[i]] if rest else best
            for name, value in zip(out, (found.astype(np.int32), sums[found], sums[best], ids[best]), strict=True):
                out[name].append(value)
        changed = {n: as_lists(v, arrow.field(n).type) for n, v in out.items()} | {"floor": pa.array(floors, pa.int64())}
        return pa.table([changed[f.name] if f.name in changed else items.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return bundles.groupBy("bundle", "shard").cogroup(owned.groupBy("to", "place")).applyInArrow(work, BUNDLE_SCHEMA)


def rank(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = 20, owners: tuple[float, ...] = OWNERS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for every row of ``items`` the ``k`` documents of the highest score above 0.

    Terms are runs of ASCII letters and digits and of any other character beyond ASCII, A-Z lower-cased. Scores are whole
    numbers: for every term of the item, repeats included, its weight times the document's share of it. Equal
    scores are ranked by ascending id.

    Defined cases: a null or empty text, also of an item, has no terms, so it is not counted as a document and never ranked;
    every row of ``docs`` is a document and every row of ``items`` an item, whatever ids repeat; null ids come after all
    others of the same score; very long texts are split in pieces and counted whole; further columns are left
    behind, whatever their names; an empty table on either side gives no rows.
    """
    asked = cut_lineage(item_terms(items, item_col, item_text_col))
    distinct = asked.select("term").distinct()
    wanted = frozenset(bytes(r["term"]) for r in distinct.collect()) if distinct.limit(FILTER_TERMS + 1).count() <= FILTER_TERMS else None
    texts = clean_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    held = cut_lineage(postings(texts, wanted).where("n > 0"))
    count, total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    m = F.lit(75) + _div(F.lit(25) * F.col("n") * F.lit(count), F.lit(max(total or 0, 1)))
    number = F.monotonically_increasing_id()  # of the checkpointed rows
    placed = held.select("doc_id", number.alias("number"), m.alias("m"), "keys", "times")
    placed = placed.withColumn("row", F.pmod("number", F.lit(SHARD)).cast("int")).withColumn("shard", F.floor(F.col("number") / SHARD).cast("long")).drop("number")

    # weight, owner and highest share of every item term
    share = F.expr("(1000000000L * x.times) div (1000L * x.times + 12L * m)")
    each = placed.select("m", F.explode(F.arrays_zip("keys", "times")).alias("x")).select(F.col("x.keys").alias("key"), share.alias("share"))
    each = each if wanted is not None else each.join(asked.select("key").distinct(), "key", "left_semi")
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0) * count + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    stage = sum(((F.col("df") > F.lit(o * count)).cast("int") for o in owners), F.lit(0))
    known = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.max("share").alias("top")).select("key", weight.alias("w"), stage.alias("stage"), "top")
    known = cut_lineage(known)
    term = F.struct("key", (F.col("w") * F.col("repeats")).alias("weight"), "stage", "top")
    bearing = asked.join(bounded_broadcast(known), "key").groupBy("item", "item_id").agg(F.array_sort(F.collect_list(term)).alias("t"))
    bearing = cut_lineage(bearing)
    bundles = max(1, ceil(bearing.count() / BUNDLE))
    bearing = bearing.select(
        F.pmod(F.xxhash64("item"), F.lit(bundles)).alias("bundle"), "item", "item_id", F.lit(0).cast("long").alias("floor"), F.col("t.key").alias("keys"),
        F.col("t.weight").alias("weights"), F.col("t.stage").alias("stages"), F.col("t.top").alias("tops"),
    )
    # every bundle has a part on every shard: the query set against all rows, in blocks
    shards = placed.select("shard").distinct().withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    travelling = shards.join(bearing, "bundle").select(
        "bundle", "shard", "item", "item_id", "floor", "keys", "weights", "stages", "tops", none("int").alias("rows"), none("long").alias("scores"),
        none("long").alias("best"), none("long").alias("best_ids"),
    )
    stages = known.select("key", F.col("stage").alias("at"))
    by_stage = {r["at"]: frozenset(r["ks"]) for r in stages.groupBy("at").agg(F.collect_set("key").alias("ks")).collect()} if wanted is not None else None
    for at in range(len(owners) + 1):
        if by_stage is not None and at not in by_stage and at < len(owners):
            continue
        owned = owned_postings(placed, stages, at, by_stage).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))))
        travelling = cut_lineage(owner_stage(travelling, owned, at, k))
        if at < len(owners):
            ordered = W.partitionBy("item").orderBy(F.desc("score"))
            kth = (
                travelling.select("item", F.explode("best").alias("score")).withColumn("place", F.row_number().over(ordered))
                .where(F.col("place") <= k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            )
            kth = bounded_broadcast(cut_lineage(kth.select("item", "kth")))
            travelling = travelling.join(kth, "item", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(0))))
            travelling = travelling.select(*(c.split(" ")[0] for c in BUNDLE_SCHEMA.split(", ")))
    found = travelling.select("item", "item_id", F.explode(F.arrays_zip("best", "best_ids")).alias("x"))
    found = found.select("item", "item_id", F.when(F.col("x.best_ids") != int(NO_ID), F.col("x.best_ids")).alias("doc_id"), F.col("x.best").alias("score"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def owned_postings(placed: DataFrame, stages: DataFrame, at: int, by_stage: dict[int, frozenset[int]] | None) -> DataFrame:
    """``(place, row, doc_id, m, keys, times)``: all documents, each with its postings of the owner's terms."""
    slim = placed.select(F.col("shard").alias("place"), "row", "doc_id", "m", "keys", "times")
    if by_stage is None:
        terms = stages.where(F.col("at") == at).select(F.col("key").alias("k"))
        each = slim.select("place", "row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("place", "row", F.col("x.keys").alias("k"), "x.times")
        met = each.join(terms, "k").groupBy("place", "row").agg(F.collect_list(F.struct("k", "times")).alias("t"))
        own = met.select("place", "row", F.col("t.k").alias("keys"), F.col("t.times").alias("times"))
        none = F.array().cast("array<long>")
        return slim.drop("keys", "times").join(own, ["place", "row"], "left").select(
            "place", "row", "doc_id", "m", F.coalesce("keys", none).alias("keys"), F.coalesce("times", none).alias("times")
        )
    mine = np.array(sorted(by_stage.get(at, ())), np.int64)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = batch.column("keys")
        offsets = lists.offsets.to_numpy()
        keys, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        kept = np.isin(keys, mine)
        ends = np.append(0, np.cumsum(kept))[offsets - offsets[0]].astype(np.int32)
        out = {c: batch.column(c) for c in ("place", "row", "doc_id", "m")}
        yield out | {n: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[kept])) for n, v in (("keys", keys), ("times", times))}

    return in_batches(slim, work, "place long, row int, doc_id long, m long, keys array<long>, times array<long>")


def sql(k: int = 20) -> str:
    """The same rows in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
    WITH tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms} AS term FROM documents) GROUP BY ALL),
    size AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
    total AS (SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS terms FROM size),
    weight AS (SELECT term, CAST(floor(1000 * ln((2e0 * texts + 2e0) / (2e0 * count(*) + 1e0))) AS BIGINT) AS w FROM tf, total GROUP BY term, texts),
    asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {terms} AS term FROM benchmark) GROUP BY ALL),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * texts) // terms)))) AS BIGINT) AS score
      FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= {k}
    """
