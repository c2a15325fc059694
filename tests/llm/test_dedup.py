"""Exact and near duplicates against brute force, and the pipeline stages on small tables."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from moundlake.llm import content_sort, simhash

COPY = "the same text again and again "


def rows_with_odds():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(150)]
    rows += [(1000 + i, COPY) for i in range(120)] + [(3, COPY), (3, COPY), (None, COPY), (None, "lonely"), (None, "lonely"), (7, None), (8, ""), (9, " \t ")]
    base = rng.choice(words, 300)
    for i in range(60):  # near copies: one word changed
        changed = base.copy()
        changed[rng.integers(0, 300)] = f"x{i}"
        rows.append((2000 + i, " ".join(changed)))
    return [*rows, (5000, "ab\x0bcd EF\x0cgh  x"), (5001, "y" * 200_000), (5002, "É é ÀB c d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_with_odds(), "doc_id long, text string").selectExpr("*", "1 AS h", "'a' AS slice", "2 AS fp", "3 AS kept")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, keep):
    rows = rows_with_odds()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = content_sort.exact_dedup(docs, keep=keep).collect()
    assert sorted(((r["row"]["doc_id"] or -1), r["row"]["text"] or "") for r in got) == sorted(((i or -1), t or "") for i, t in rows)
    best = min if keep == "smallest" else max
    for r in got:
        ids = groups[r["row"]["text"] or ""]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == best((i for i in ids if i is not None), default=None)
    kept = Counter(r["row"]["text"] or "" for r in got if r["kept"])
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert content_sort.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_normalised_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None)], "doc_id long, text string")
    got = content_sort.exact_dedup(df, normalise=lambda t: F.lower(F.regexp_replace(t, " +", " "))).collect()
    assert sorted((r["row"]["doc_id"], r["keep_id"], r["row"]["text"]) for r in got) == [(1, 1, "A b"), (2, 1, "a  B"), (3, 3, None)]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius):
    """{fingerprint: smallest fingerprint-linked set index}"""
    todo, out = set(prints), {}
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            edge = {f for f in todo if any((f ^ g).bit_count() <= radius for g in edge)}
            todo -= edge
        for f in group:
            out[f] = min(group)
    return out


@pytest.mark.parametrize(("radius", "dense", "parts"), [(2, 256, (2, 3)), (2, 2, (3,)), (2, 0, (2,)), (4, 256, (2, 3)), (4, 8, (3,))])
def test_near_groups(docs, radius, dense, parts):
    rows = rows_with_odds()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    part = plain_components([f for _, f in prints], radius)
    least = defaultdict(lambda: None)
    for i, f in prints:
        if i is not None and (least[part[f]] is None or i < least[part[f]]):
            least[part[f]] = i
    got = simhash.near_groups(docs, radius=radius, dense_bucket=dense, parts=parts)
    found = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect())
    assert found == Counter((i, f, least[part[f]]) for i, f in prints)
    assert len({part[f] for _, f in prints}) < len({f for _, f in prints})


def test_near_groups_of_nothing(docs):
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(500))).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())
    assert simhash.fingerprint(b"a") == plain_fingerprint("a") and simhash.fingerprint(b"") == 0


def test_thresholds_are_a_valid_pigeonhole():
    rng = np.random.default_rng(0)
    for parts, radius in ((2, 2), (3, 2), (3, 4), (4, 6)):
        costs = [np.vstack([np.zeros(50), np.sort(rng.random((radius + 1, 50)) * 100, axis=0)]) for _ in range(parts)]
        chosen, total = simhash.allocate(costs, radius)
        assert (chosen.sum(axis=0) == radius - parts + 1).all() and (chosen >= -1).all()
        assert np.allclose(sum(c[chosen[i] + 1, np.arange(50)] for i, c in enumerate(costs)), total)


def test_drop_near_keeps_one_of_a_group(docs):
    left = [(r["doc_id"], r["text"]) for r in simhash.drop_near(docs).collect()]
    groups = {r["component_id"] for r in simhash.near_groups(docs).collect()} - {None}
    assert groups <= {i for i, _ in left} and (None, "lonely") in left and len(left) < docs.count()
