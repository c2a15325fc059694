"""The mixing operator's small cases and the pipeline, stage by stage."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moundlake.llm import mixing, occurrences


def mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS tokens", "2 AS row")
    return [r.asDict(recursive=True) for r in mixing.mix(df, **how).collect()]


ROWS = [(i, f"a b c d{i}", "big") for i in range(300)] + [(1000 + i, f"e f{i}", "small") for i in range(20)] + [
    (None, "no id", None), (1, None, "big"), (2, "", ""), (2, "", ""), (4, "word " * 500, "long")]


@pytest.mark.parametrize("how", [
    {"budget_ratio": 1.0, "max_repeats": 3.0, "entropy_share": None}, {"budget_ratio": 0.3, "max_repeats": None, "entropy_share": 0.9},
    {"budget_ratio": None, "max_repeats": 2.0, "entropy_share": None}, {"budget_ratio": 5.0, "max_repeats": 2.0, "entropy_share": None},
])
def test_mix_keeps_its_limits(spark, how):
    rows = mixed(spark, ROWS, block_tokens=50, **how)
    tokens, used = Counter(), Counter()
    for _, t, s in ROWS:
        tokens[s or ""] += max(1, len((t or "").split()))
    streams = defaultdict(list)
    for r in rows:
        used[r["row"]["source"] or ""] += r["tokens"]
        streams[r["row"]["source"] or ""].append((r["start"], r["tokens"], r["epoch"], r["row"]["doc_id"], r["row"]["text"]))
    quota = {(r["row"]["source"] or ""): r["quota"] for r in rows}
    for s, stream in streams.items():
        stream.sort(key=lambda x: x[0])
        assert all(a + n <= quota[s] for a, n, *_ in stream) and all(x[0] + x[1] <= y[0] for x, y in zip(stream, stream[1:], strict=False))
        for epoch in {x[2] for x in stream}:  # without repeats in an epoch
            counts = Counter(x[3:] for x in stream if x[2] == epoch)
            every = Counter((i, t) for i, t, q in ROWS if (q or "") == s)
            assert all(counts[k] <= every[k] for k in counts)
    if how["max_repeats"]:
        least = min(quota[s] / tokens[s] for s in quota) if how["budget_ratio"] is None else 1
        assert all(quota[s] <= how["max_repeats"] * tokens[s] * max(least, 1) * 1.001 + 1 for s in quota)
    if how["budget_ratio"] is None:
        assert {(r["row"]["doc_id"], r["row"]["text"]) for r in rows} == {(i, t) for i, t, _ in ROWS}


@pytest.mark.parametrize("how", [{"entropy_rise": 0.0}, {"entropy_rise": None, "entropy_share": 0.01}, {"entropy_rise": None, "max_repeats": 1.0}])
def test_a_mix_that_changes_nothing_uses_every_row_once(spark, how):
    rows = mixed(spark, ROWS, block_tokens=50, **how)
    assert Counter((r["row"]["doc_id"], r["row"]["text"], r["row"]["source"]) for r in rows) == Counter(ROWS)
    assert {r["epoch"] for r in rows} == {0} and {r["limits_met"] for r in rows} == {"entropy_share" not in how}


@pytest.mark.parametrize("rise", [0.3, 0.5, 1.0])
def test_mix_meets_an_entropy_between_the_shares_and_the_largest(spark, rise):
    given = ROWS[:-1]  # no text longer than a quota
    rows = mixed(spark, given, block_tokens=50, max_repeats=None, entropy_rise=rise)
    quota = {(r["row"]["source"] or ""): r["quota"] for r in rows}
    tokens = Counter()
    for _, t, s in given:
        tokens[s or ""] += max(1, len((t or "").split()))

    def entropy(weights):
        return -sum(w / sum(weights) * math.log(w / sum(weights)) for w in weights)

    low = entropy(tokens.values())
    assert set(quota) == set(tokens) and sum(quota.values()) == sum(tokens.values())  # the budget to the token
    assert entropy(quota.values()) == pytest.approx(low + rise * (math.log(len(tokens)) - low), abs=2e-3)
    assert max(r["epoch"] for r in rows) > 0 and all(r["limits_met"] for r in rows)


def test_mix_of_nothing_and_of_one(spark):
    assert mixed(spark, [(1, "a", "s")], budget_ratio=2.0, entropy_share=None)[0]["quota"] == 2
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == columns, name
        left = left.checkpoint()
        sizes.append(left.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] <= sizes[4]
    texts = [r["text"] for r in left.select("doc_id", "text").distinct().collect()]
    assert len(texts) == len(set(texts)) == sizes[3]
    tokens = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert tokens.where("NOT exact").count() == 0 and tokens.count() >= 2 * sizes[4] - 2
    assert corpus_pipeline.run(spark, sf).count() == tokens.count()


def test_stages_on_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(1, None, None, None, None), (None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (2, "", "x", "t", 0), (3, "one two", None, "s", 7), (3, "one two", None, "s", 7)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert (docs.count() > 0) == bool(data)


def test_near_copies_are_all_found_and_verified(spark):
    """Planted pairs around every similarity and a hot group, against brute force over whole texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for changes in [1, 2, 3, 4, 5, 6, 7, 8] * 6:  # each change of 200 words costs up to five shingles
        one = [word() for _ in range(200)]
        other = list(one)
        for at in rng.sample(range(200), changes):
            other[at] = word()
        texts += [one, other]
    stem = [word() for _ in range(120)]
    for _ in range(90):  # more than one hub reaches
        copy = list(stem)
        for at in rng.sample(range(120), 2):
            copy[at] = word()
        texts.append(copy)
    texts += [passage + [word() for _ in range(60)] for _ in range(80)]
    texts = [" ".join(t) for t in texts] + ["", "one two", "One  two\n", "one two three"]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    similar_by = Counter()
    for b in range(len(texts)):
        for a in range(b):
            share = len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1)
            if share >= 0.8 and texts[a].split():
                similar_by[int(share * 20)] += 1
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert all(similar_by[k] for k in (16, 17, 18, 19))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in occurrences.groups(docs).collect()}
    assert found == dict(enumerate(group))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(group)


def test_near_copies_without_an_id_or_with_a_repeated_one_go_too(spark):
    """One row of each component stays, whatever the ids; against brute force over rows."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for ids in ([5, None], [None, None, None], [7, 2, 7], [7], [None], [30, 30], [None, 30, 31]):
        stem = [word() for _ in range(100)]
        rows += [(i, " ".join([*stem[:k], word(), *stem[k + 1 :]])) for k, i in enumerate(ids)]  # two copies differ in two words at most
    rows += [(None, ""), (None, None), (40, " ")]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for _, t in rows)]
    group = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert sorted(Counter(group).values()) == [1] * 5 + [2] * 2 + [3] * 3
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(group[r["n"]] for r in kept) == sorted(set(group))
    for r in kept:
        ids = [rows[n][0] for n in range(len(rows)) if group[n] == group[r["n"]]]
        assert r["doc_id"] == min((i for i in ids if i is not None), default=None)
    assert {(r["doc_id"], r["text"]) for r in kept} == {rows[r["n"]] for r in kept}


def test_near_copies_start_from_simhash_groups(spark, monkeypatch):
    """SimHash groups reach the exact search, which joins only those that are similar indeed."""
    seen = []
    search = occurrences.drop_near
    monkeypatch.setattr(occurrences, "drop_near", lambda docs, **k: seen.append(k["hints"]) or search(docs, **k))
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words) + " end", " ".join(w.upper() for w in words), "other words than these", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, 3, 4}
    assert {(0, 0), (2, 0)} <= {(r["doc_id"], r["hint"]) for r in seen[0].collect()}


def test_hints_are_checked_before_they_join():
    one, near, far = np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64), np.arange(60, 200, dtype=np.uint64)
    calls = []
    plain = occurrences.Lists.search

    def counted(self, query, percent, skip):
        return plain(self, query, percent, lambda f: calls.append(int(skip(f).sum())) or skip(f))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(occurrences.Lists, "search", counted)
        root = occurrences.local_components([one, near, far], 80, [7, 7, 7])
    assert root[0] == root[1] != root[2]
    assert calls[0] == 2  # the search goes past the joined text at once


FIELDS = [("doc_id", pa.int64()), ("samples", pa.list_(pa.struct([
    ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("value", pa.float64()), ("log_inclusion", pa.float64()), ("exact", pa.bool_()),
])))]


def test_the_last_stage_hands_over_few_texts_at_a_time(spark, monkeypatch):
    """Batches that the stage's operator gets, on rows that fit one default batch."""
    monkeypatch.setattr(corpus_pipeline.sampling, "encode", lambda docs, k: docs.mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"doc_id": [b.num_rows], "samples": [None]}, schema=pa.schema(FIELDS)) for b in batches),
        "doc_id long, samples array<struct<ids:array<int>,log_prob:double,value:double,log_inclusion:double,exact:boolean>>",
    ).withColumn("samples", F.expr("array(named_struct('ids', array(1), 'log_prob', 0D, 'value', 0D, 'log_inclusion', 0D, 'exact', true))")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        sizes = [r["doc_id"] for r in corpus_pipeline.encode(spark, spark.range(5_000, numPartitions=1), "").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(sizes) == 5_000 and max(sizes) <= corpus_pipeline.ARROW_ROWS
