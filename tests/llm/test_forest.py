"""Nearest neighbours by the hash-prefix forest against brute force."""

import numpy as np
import pytest

from moundlake.llm import catalogue, forest


def brute(rows, queries, k):
    """{query id: [(id, score)]} over distinct rows, ties to the smaller id."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in good:
        if q in queries:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in rows], {r["vec_id"] for r in rows if r["vec_id"] % 20 == 0}, 20)
    got: dict = {}
    for r in catalogue.queries()["op4_hash_forest"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        scores = dict(want[q])
        hits += sum(i in scores and s == pytest.approx(scores[i], abs=1e-12) for _, i, s in found)
    assert hits / (20 * len(want)) >= 0.9


def test_odd_rows_and_hot_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)] + [(40, rows[40][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 1.0, 1.0, 1.0]),
             (None, [1.0] * 4), (2006, [1.0, 2.0]), (2007, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS vec")
    asked = df.where("vec_id % 20 = 0 OR vec_id >= 2000")
    # ranges as wide as the shard: the search is exact then, over several shards and blocks
    got: dict = {}
    for r in forest.nearest(df, asked, k=5, candidates=64, shard_rows=50, query_block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, {r["vec_id"] for r in asked.collect()}, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [f[1] for f in sorted(found)] == [i for i, _ in want[q]], q
        assert [f[2] for f in sorted(found)] == pytest.approx([s for _, s in want[q]])
    assert forest.nearest(df.limit(0), asked.limit(0)).count() == 0


def test_longest_prefix_and_ascent():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8))
    f = forest.Forest(points, 4, 16, 7)
    for t in range(4):
        assert (np.diff(f.keys[t]) >= 0).all()
    few, many = ([len(c) for c in f.candidates(points[:20], n)] for n in (10, 200))
    assert all(a <= b for a, b in zip(few, many, strict=True))


def test_small_groups_find_all_their_neighbours(spark):
    """Unit vectors in shards of few rows, with the parameters of the query."""
    rng = np.random.default_rng(8)
    unit = lambda d: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=d))
    rows = [(i, unit(8)) for i in range(15)] + [(100 + i, unit(16)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in forest.nearest(df, df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got[i]) == (14 if i < 100 else 20) for i, _ in rows)
    assert all(got[i] == set(range(15)) - {i} for i in range(15))
