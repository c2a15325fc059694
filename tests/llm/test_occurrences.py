"""Similar texts by T-occurrence search against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from moundlake.llm import occurrences
from moundlake.llm.similar import Hasher


def shingles_of(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    seq = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return frozenset(tuple(seq[i : i + words]) for i in range(max(len(seq) - words + 1, 1))) if seq else frozenset()


def plain(rows, percent):
    """Expected rows, every two texts compared."""
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    return Counter((doc, len(s), ids.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def texts():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(3000)])
    draw = lambda n: list(rng.choice(words, n))
    rows = [(i, " ".join(draw(rng.integers(1, 60)))) for i in range(60)]
    at = 100
    for size in (6, 9, 12, 60, 75, 85, 150, 400):
        for _ in range(3):
            base = draw(size)
            for edits in range(0, 1 + size // 25):
                changed = base.copy()
                for k in rng.integers(0, size, edits):
                    changed[k] = f"x{rng.integers(10**6)}"
                rows.append((at, " ".join(changed)))
                rows.append((at + 1, " ".join(base + draw(size // 5))))
                at += 2
    base, passage = draw(200), draw(70)
    for _ in range(80):  # a large group of near copies, some of which are only linked through others
        changed = base.copy()
        for k in rng.integers(0, 200, rng.integers(1, 6)):
            changed[k] = f"y{rng.integers(10**6)}"
        rows.append((at, " ".join(changed)))
        rows.append((at + 1, " ".join(draw(rng.integers(2, 30)) + passage)))
        at += 2
    rows += [(at + i, "The same  Text again") for i in range(40)] + [(7, "the same text\nagain")] * 2
    rows += [(None, "the same text again"), (None, "lonely one"), (None, "lonely one"), (3, None), (4, ""), (5, " \t\x0b ")]
    rows += [(9000, "É é ÀB c d f"), (9001, "é É ÀB c d f"), (9002, "É é Àb C D F"), (9003, "q" * 300_000)]
    return rows + [(8, " ".join(draw(30_000)))]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.mark.parametrize(("percent", "block"), [(80, 2_000_000), (80, 2_000), (75, 900), (95, 5_000), (100, 2_000_000)])
def test_groups(spark, monkeypatch, rows, percent, block):
    monkeypatch.setattr(occurrences, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(occurrences, "BUCKET_ENTRIES", 3_000)
    monkeypatch.setattr(occurrences, "SLICE_BYTES", 60_000 if block < 10_000 else 16 << 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'a' AS bucket", "2 AS component_id")
    got = occurrences.groups(df.repartition(3), percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain(rows, percent)


def test_search_finds_all_and_only_similar_texts(rows):
    hasher = Hasher(5)
    sets = list({s.tobytes(): s for s in (hasher.shingles((t or "").encode()) for _, t in rows)}.values())
    lists = occurrences.Lists(sets)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert set(lists.search(a, 80, lambda f: np.zeros(len(f), bool)).tolist()) == want, i


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert occurrences.groups(df).count() == 0
    some = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert sorted(((r[0] or 0), r[1], (r[2] or 0)) for r in occurrences.groups(some).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_needs_a_share_above_what_is_probed():
    with pytest.raises(ValueError):
        occurrences.groups(None, percent=70)
