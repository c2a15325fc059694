"""Join of texts by the Jaccard similarity of their word n-grams, as a T-occurrence search over inverted lists (DivideSkip).

A text of ``n`` shingles and any text similar to it share at least ``T = ceil(least * n)`` of them: a
similar text stands in at least ``T`` of the text's inverted lists. The search runs in three parts:

1. Lists of one text can't count. Texts too few of whose shingles stand in any longer list are left out,
   which on common text are nearly all. A fixed share of the hash range decides that, so that
   only that share of all shingles is shuffled; the test is a necessary condition, hence exact.
2. What is left is dealt into blocks of whole texts, each with its own inverted lists. In a block a query merges
   its short lists, keeps those that occur often enough, and probes the long lists for them by
   binary search. First every block is searched with its own texts.
3. Two similar texts share one of each other's ``n - T + 1`` rarest shingles. Where a list of these still holds several
   components, all but those of its commonest component are sent as queries to the blocks that the list touches. Texts of one
   component needn't be compared again, so a large group of near copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.llm.common import clean_texts, cut_lineage, in_batches
from moundlake.llm.similar import Hasher, set_hash
from moundlake.operators.graph import connected_components
from moundlake.runtime import bounded_broadcast

# Share of the hash range whose shingles tell texts without a partner apart. It must exceed 1 - least.
PROBED = 0.3
# Texts of at most so many shingles are told apart by all of them.
SMALL = 64
# Shingles and texts of a block at most, unless one text alone has more.
BLOCK_SHINGLES, BLOCK_TEXTS = 500_000, 8_192
# Probed shingles of a group of lists on average, and bytes of text that are hashed together.
BUCKET_ENTRIES, SLICE_BYTES = 100_000, 8 << 20
# Weight of a merged list entry against a binary probe: DivideSkip sets T / (MU * log2(longest) + 1) lists aside.
MU = 0.01


def occurrences_needed(size: int, percent: int) -> int:
    """Shingles that a text of ``size`` shingles shares at least with any similar one."""
    return -(-percent * size // 100)


class Lists:
    """Inverted lists of a block of texts: for every shingle the sorted numbers of the texts that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.texts = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.starts = np.unique(shingles[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(shingles))

    def search(self, query: np.ndarray, percent: int, skip) -> np.ndarray:
        """Numbers of the texts whose similarity to the sorted set ``query`` is at least ``percent`` of a hundred.

        ``skip(texts)`` marks candidates that needn't be told apart.
        """
        n = len(query)
        least = occurrences_needed(n, percent)
        at = np.searchsorted(self.keys, query)
        at = at[at < len(self.keys)] if len(at) and at[-1] >= len(self.keys) else at
        at = at[self.keys[at] == query[: len(at)]]
        if len(at) < least or not n:
            return np.zeros(0, np.int64)
        starts, ends = self.starts[at], self.ends[at]
        by_length = np.argsort(ends - starts, kind="stable")
        starts, ends = starts[by_length], ends[by_length]
        longest = max(int(ends[-1] - starts[-1]), 2)
        aside = min(least - 1, int(least / (MU * log2(longest) + 1)))
        short = len(at) - aside
        # a stable sort merges the sorted runs of the short lists
        merged = np.sort(np.concatenate([self.texts[a:b] for a, b in zip(starts[:short], ends[:short], strict=True)]), kind="stable")
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found, times = merged[first], np.diff(np.append(first, len(merged)))
        sizes = self.sizes[found]
        # inter >= p (n + size - inter) / 100
        wanted = -(-percent * (n + sizes) // (100 + percent))
        kept = (times + aside >= wanted) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes)
        kept &= ~skip(found)
        found, times, wanted = found[kept], times[kept], wanted[kept]
        for k in range(len(at) - 1, short - 1, -1):
            if not len(found):
                break
            long = self.texts[starts[k] : ends[k]]
            place = np.searchsorted(long, found)
            times = times + ((place < len(long)) & (long[np.minimum(place, len(long) - 1)] == found))
            open_ = times + (k - short) >= wanted
            if not open_.all():
                found, times, wanted = found[open_], times[open_], wanted[open_]
        return found[times >= wanted]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have an intersection of at least ``percent`` hundredths of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def local_components(sets: list[np.ndarray], percent: int, hints: list[int | None] | None = None) -> np.ndarray:
    """For each text of a block the number of one text of its component, the same for all of it.

    Texts of one hint are compared with the first of them and, where similar indeed, joined before
    the search, which then goes past them.
    """
    lists, root = Lists(sets), np.arange(len(sets))
    members = {i: [i] for i in range(len(sets))}

    def join(one: int, other: int) -> None:
        a, b = int(root[one]), int(root[other])
        if a == b:
            return
        if len(members[a]) < len(members[b]):
            a, b = b, a
        moved = members.pop(b)
        root[moved] = a
        members[a] += moved

    first: dict[int, int] = {}
    for i, hint in enumerate(hints or ()):
        if hint is not None and first.setdefault(hint, i) != i and alike(sets[first[hint]], sets[i], percent):
            join(first[hint], i)
    for q, own in enumerate(sets):
        for other in lists.search(own, percent, lambda found, q=q: root[found] == root[q]):
            join(q, int(other))
    return root


def as_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False)).view(np.uint64) if v.is_valid else np.zeros(0, np.uint64) for v in column]


def block_roots(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` within every block of ``(node, block, shingles)``; the root is one of the block's nodes."""

    def work(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        return pa.table({"node": nodes, "root": nodes[local_components(as_sets(table.column("shingles")), percent)]})

    return sets.groupBy("block").applyInArrow(work, "node long, root long")


def list_lengths(sets: DataFrame) -> DataFrame:
    """``(to, shingles, lengths)``: for every block of ``(node, block, shingles)`` the shingles it holds and their lists' lengths over all blocks.

    A block sends each of its shingles once with its own count, so texts alike in one block cost what one of them does.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    buckets = max(1, total // BLOCK_SHINGLES)

    def counted(table: pa.Table) -> pa.Table:
        shingles, counts = np.unique(np.concatenate(as_sets(table.column("shingles"))), return_counts=True)
        bucket = (shingles % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
        return pa.table({
            "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int64()),
            "shingles": pa.array([shingles[p].tobytes() for p in parts], pa.binary()), "counts": pa.array([counts[p].astype(np.int64).tobytes() for p in parts], pa.binary()),
        })

    def summed(table: pa.Table) -> pa.Table:
        shingles = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("shingles")]
        counts = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("counts")])
        keys, place = np.unique(np.concatenate(shingles), return_inverse=True)
        lengths = np.bincount(place, counts, len(keys)).astype(np.int64)[place]
        ends = np.cumsum([len(s) for s in shingles])
        return pa.table({
            "to": table.column("block"), "shingles": table.column("shingles"),
            "lengths": pa.array([part.tobytes() for part in np.split(lengths, ends[:-1])], pa.binary()),
        })

    counts = sets.groupBy("block").applyInArrow(counted, "bucket long, block long, shingles binary, counts binary")
    return counts.groupBy("bucket").applyInArrow(summed, "to long, shingles binary, lengths binary")


def roots_and_short_lists(sets: DataFrame, lengths: DataFrame, percent: int) -> DataFrame:
    """Of ``(node, hint, block, shingles)``: ``(node, block, root, short)``, the root within the block, and the text's first ``n - T + 1`` shingles, those of the shortest lists.

    Lists of one text are left out of ``short``.
    """

    def work(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "short": pa.array([], pa.list_(pa.int64()))})
        keys, length = (np.concatenate([np.frombuffer(b.as_py(), kind) for b in known.column(c)]) for c, kind in (("known", np.uint64), ("lengths", np.int64)))
        order = np.argsort(keys)
        keys, length = keys[order], length[order]
        texts, short = as_sets(table.column("shingles")), []
        for own in texts:
            df = length[np.searchsorted(keys, own)]
            first = np.lexsort((own, df))[: len(own) - occurrences_needed(len(own), percent) + 1]
            short.append(own[first[df[first] > 1]].view(np.int64))
        nodes = table.column("node").to_numpy()
        return pa.table({
            "node": nodes, "block": table.column("block"), "root": nodes[local_components(texts, percent, table.column("hint").to_pylist())], "short": pa.array(short, pa.list_(pa.int64())),
        })

    known = lengths.select("to", F.col("shingles").alias("known"), "lengths")
    return sets.groupBy("block").cogroup(known.groupBy("to")).applyInArrow(work, "node long, block long, root long, short array<long>")


def routed_links(index: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: roots that a query and a text of another component connect.

    ``index(block, root, shingles)`` are whole blocks, ``queries(to, asking, query)`` the texts sent to them. A pair of
    roots comes once a block at most.
    """

    def work(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not texts.num_rows or not asked.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        roots, own = texts.column("root").to_numpy(), asked.column("asking").to_numpy()
        lists, linked = Lists(as_sets(texts.column("shingles"))), set()
        for root, query in zip(own.tolist(), as_sets(asked.column("query")), strict=True):
            found = lists.search(query, percent, lambda f, root=root: roots[f] == root)
            linked.update((min(root, r), max(root, r)) for r in np.unique(roots[found]).tolist())
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    return index.groupBy("block").cogroup(queries.groupBy("to")).applyInArrow(work, "a long, b long")


def dealt_into_blocks(sets: DataFrame, seed: int) -> DataFrame:
    """``sets`` with a column ``block``: texts alike mostly share the least of their shingles under a hash, so they come together.

    A number of blocks in proportion to all shingles; one that gets too much is split by a hash of the node.
    """
    keyed = sets.withColumn("_key", F.xxhash64(F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.lit(seed))))))
    total = keyed.agg(F.sum(F.size("shingles")), F.count(F.lit(1))).first()
    many = max(1, ceil(2 * (total[0] or 0) / BLOCK_SHINGLES), ceil(2 * total[1] / BLOCK_TEXTS))
    placed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(many)))
    parts = F.greatest(F.ceil(F.sum(F.size("shingles")) / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)))
    loads = placed.groupBy("_bucket").agg(parts.cast("long").alias("_parts"))
    salt = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_parts"))
    return placed.join(bounded_broadcast(cut_lineage(loads)), "_bucket").withColumn("block", F.xxhash64("_bucket", salt)).drop("_key", "_bucket", "_parts")


def hashed_rows(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """One pass over ``(doc_id, text, digest)``: a row ``(doc_id, digest, node, n, probed, met)`` each, and the probed shingles of every slice by ``bucket``.

    ``probed`` of a text's shingles are asked for, ``met`` of them stand in another text of the same slice already. Of
    a list that is longer within a slice one entry goes on, so a frequent shingle is sent once a slice.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, ceil(total * PROBED / 6 / BUCKET_ENTRIES))
    edge = np.uint64(int(PROBED * 2**64))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        hasher, place, sets = Hasher(words), {}, []
        node, n, probed, first = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = hasher.shingles(text)
            key = set_hash(found)
            first.append(key not in place)
            if first[-1]:
                place[key] = len(sets)
                low = found < edge
                # a small text asks with all its shingles, so all that can be similar to it lend all of theirs
                own = np.ones(len(found), bool) if len(found) <= SMALL else low
                lent = own | low | (len(found) <= SMALL * 100 // percent)
                sets.append((found[lent], own[lent]))
            node.append(key)
            n.append(len(found))
            probed.append(int(sets[place[key]][1].sum()))
        shingles = np.concatenate([s for s, _ in sets])
        own = np.concatenate([o for _, o in sets])
        number = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        order = np.argsort(shingles, kind="stable")
        shingles, own, number = shingles[order], own[order], number[order]
        starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1])) if len(shingles) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(shingles)))
        longer = np.repeat(lengths > 1, lengths)
        met = np.bincount(number[longer & own], minlength=len(sets))
        nothing, rows_here = [None] * batch.num_rows, batch.num_rows
        yield {
            "doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "node": node, "n": n, "probed": probed,
            "met": [int(met[place[k]]) if f else 0 for k, f in zip(node, first, strict=True)],
            "bucket": nothing, "shingles": nothing, "nodes": nothing, "flags": nothing,
        }
        sent = np.zeros(len(shingles), bool)
        sent[starts] = True
        flags = np.where(longer, 2, own.astype(np.uint8)).astype(np.uint8)[sent]
        nodes, shingles = np.array(list(place), np.int64)[number[sent]], shingles[sent]
        bucket = (shingles % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = [p for p in np.split(order, cuts) if len(p)]
        nothing = [None] * len(parts)
        yield {
            "doc_id": nothing, "digest": nothing, "node": nothing, "n": nothing, "probed": nothing, "met": nothing, "bucket": [int(bucket[p[0]]) for p in parts],
            "shingles": [shingles[p].tobytes() for p in parts], "nodes": [nodes[p].tobytes() for p in parts], "flags": [flags[p].tobytes() for p in parts],
        }

    schema = "doc_id long, digest long, node long, n int, probed int, met int, bucket int, shingles binary, nodes binary, flags binary"
    return in_batches(rows, work, schema, max_bytes=SLICE_BYTES)


def with_partner(found: DataFrame, percent: int) -> DataFrame:
    """``node`` of the texts that can have a similar one, by their probed shingles: an exact necessary condition.

    Of the probed shingles of a text at most ``n - T`` may stand in no other text. Copies of a text in several
    slices can only raise its count.
    """

    def lists(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(b.as_py(), kind) for b in table.column(name)])
        shingles, nodes, flags = read("shingles", np.uint64), read("nodes", np.int64), read("flags", np.uint8)
        order = np.lexsort((nodes, shingles))
        shingles, nodes, flags = shingles[order], nodes[order], flags[order]
        again = np.append(False, shingles[1:] == shingles[:-1])
        starts = np.flatnonzero(~again)
        other = again & np.append(False, nodes[1:] != nodes[:-1])
        shared = np.add.reduceat((other | (flags == 2)).astype(np.int64), starts) > 0
        mine = np.repeat(shared, np.diff(np.append(starts, len(shingles)))) & (flags == 1)
        mine &= ~(again & ~other)
        node, met = np.unique(nodes[mine], return_counts=True)
        return pa.table({"node": node, "met": met.astype(np.int64)})

    texts = found.where("bucket IS NULL AND n > 0")
    replies = found.where("bucket IS NOT NULL").select("bucket", "shingles", "nodes", "flags").groupBy("bucket").applyInArrow(lists, "node long, met long")
    counts = texts.groupBy("node").agg(F.first("n").alias("n"), F.first("probed").alias("probed"), F.sum("met").alias("near"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    met = F.col("near") + F.coalesce("far", F.lit(0))
    far = replies.groupBy("node").agg(F.sum("met").alias("far"))
    return counts.join(far, "node", "left").where(F.col("probed") - met <= spare).select("node")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, hints: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row: components of texts whose sets of ``words``-word
    shingles have an intersection of at least ``percent`` hundredths of their union.

    A-Z are lower-cased, words are runs of anything but white space; a text of fewer words is one shingle of all
    of them. Shingles are compared by 64-bit hashes. ``component_id`` is the smallest id reachable by links.
    ``hints`` ``(doc_id, hint)`` names texts that were found near by other means: those of one hint that meet in
    a block are told apart or joined before the search. The components are the same without them.

    Defined cases: null or empty texts and those without words have no shingles and are linked with nothing, each
    is its own component; rows with equal sets are linked and worked on as one; null ids never name a component, one of
    null ids only has a null id; repeated rows come back as often as they went in; further columns are left
    behind, whatever their names; very long texts are hashed in pieces and searched whole; an empty table gives no rows.
    """
    return components(docs, id_col, text_col, words, percent, hints).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, hints: DataFrame | None) -> DataFrame:
    """The rows of ``groups`` with ``digest``, a hash of the text, and ``stays``: whether the row stands for its component.

    That is the one with the least id, null ids last, and of these the one with the least digest. Texts without words stand for themselves.
    """
    if not 100 * (1 - PROBED) < percent <= 100:
        raise ValueError("percent must be above 70 and at most 100")
    rows = clean_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).withColumn("digest", F.xxhash64("text"))
    found = cut_lineage(hashed_rows(rows, words, percent))
    alive = cut_lineage(with_partner(found, percent))
    found = found.where("bucket IS NULL").select("doc_id", "digest", "node", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "digest")).alias("first")
    named = cut_lineage(found.where("n > 0").groupBy("node").agg(first).withColumn("least_id", F.col("first.id")))

    def whole(batch: pa.RecordBatch) -> Iterator[dict]:
        hasher = Hasher(words)
        sets = [hasher.shingles(t) for t in batch.column("text").to_pylist()]
        yield {"node": [set_hash(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    ids = cut_lineage(named.join(alive, "node").select(F.col("least_id").alias("asked id")).distinct())
    texts = rows.join(bounded_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("asked id")), "left_semi")
    sets = in_batches(texts, whole, "node long, shingles array<long>", max_bytes=2 << 20)
    sets = cut_lineage(sets.join(bounded_broadcast(alive), "node", "left_semi").dropDuplicates(["node"]))

    if hints is None:
        sets = sets.withColumn("hint", F.lit(None).cast("long"))
    else:
        near = hints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("hint").alias("hint"))
        sets = sets.join(cut_lineage(named.join(near, F.col("least_id") == F.col("doc_id")).select("node", "hint")), "node", "left")

    sets = cut_lineage(dealt_into_blocks(sets, 0))
    rare = cut_lineage(roots_and_short_lists(sets, list_lengths(sets), percent))
    roots = rare.select("node", "root")
    # one text a component, dealt anew: large groups that lay in several blocks come together
    if sets.select("block").distinct().limit(2).count() > 1:
        heads = sets.drop("block", "hint").join(roots.select("root").distinct().withColumnRenamed("root", "node"), "node", "left_semi")
        higher = cut_lineage(block_roots(dealt_into_blocks(cut_lineage(heads), 1), percent).withColumnRenamed("root", "top"))
        roots = cut_lineage(roots.join(higher.withColumnRenamed("node", "root"), "root").select("node", F.col("top").alias("root")))

    placed = rare.drop("root").join(roots, "node")
    listed = cut_lineage(placed.select("node", "root", "block", F.explode("short").alias("shingle")))
    each = listed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("texts"))
    mixed = each.groupBy("shingle").agg(F.max_by("root", F.struct("texts", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = cut_lineage(mixed.select("shingle", "major"))
    naming = roots
    if not mixed.isEmpty():
        asking = listed.join(mixed, "shingle").where("root <> major").select("shingle", "node", "root")
        touched = listed.join(mixed, "shingle", "left_semi").groupBy("shingle", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        sent = asking.join(touched, "shingle").where("lo <> root OR hi <> root").select("node", F.col("root").alias("asking"), F.col("block").alias("to")).distinct()
        queries = cut_lineage(sent).join(sets.select("node", F.col("shingles").alias("query")), "node").select("to", "asking", "query")
        links = cut_lineage(routed_links(sets.join(roots, "node").select("block", "root", "shingles"), queries, percent))
        joined = connected_components(links.select(F.lit(0).alias("part"), "a", "b"), "part").select(F.col("node").alias("root"), F.col("root").alias("top"))
        naming = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    members = cut_lineage(naming.join(named, "node"))
    firsts = members.groupBy("root").agg(F.min("first").alias("top"))
    known = named.join(members.join(firsts, "root").select("node", "top"), "node", "left")
    known = cut_lineage(known.select("node", F.coalesce("top", "first").alias("first")))
    empty = F.col("n_shingles") == 0
    return found.select("doc_id", "digest", "node", F.col("n").cast("long").alias("n_shingles")).join(known, "node", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id"), "digest",
        (empty | (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))).alias("stays"),
    )


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, hints: DataFrame | None = None,
) -> DataFrame:
    """``docs`` without the near copies: of each component one document stays, that with the least id.

    Rows are told apart by id and text, so rows with a null id, which lose to any other, and rows that repeat an id go
    like others; of equal ids the text with the least hash stays. Rows that repeat id and text stay or go together; all texts without words stay.
    """
    found = components(docs, id_col, text_col, words, percent, hints)
    gone = found.where("NOT stays").select(F.col("doc_id").alias("gone id"), F.col("digest").alias("gone digest")).distinct()
    same_text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")) == F.col("gone digest")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("gone id")) & same_text, "left_anti")


def sql(words: int = 5, percent: int = 80) -> str:
    """The same rows in DuckDB SQL, by counting the common shingles of every two texts that share one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE split AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingle AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
    size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
    linked AS MATERIALIZED (
      SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(p.n) + any_value(q.n) - count(*))),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size USING (doc_id)
    JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)
    """
