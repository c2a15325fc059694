"""Ranked search over term owners against plain counting."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from moundlake.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    count, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * count) // total
            score = sum(
                n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, n in Counter(terms_of(text)).items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(900)])
    odds = 1 / np.arange(1, 901)
    draw = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, draw(rng.integers(1, 120))) for i in range(600)]
    docs += [(1000 + i, "Same text, same W1 w2!") for i in range(60)]
    docs += [(5, None), (6, ""), (7, " -- \t"), (None, "same w1"), (None, "same w1"), (8, "same w1"), (8, "same w1"), (9, "ÉÀ é_É w1w2 \x00w3")]
    docs += [(10, "w5 " * 60_000 + "rare"), (11, "rare-rare.RARE")]
    items = [(i, draw(rng.integers(1, 25))) for i in range(30)] + [(100, "same same SAME w1"), (101, "nowhere"), (102, None), (103, ""), (104, "É é rare"), (104, "rare")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS item", "'x' AS keys")
    return d.repartition(3), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS item", "3 AS score")


@pytest.mark.parametrize(("owners", "bundle", "shard", "known", "k"), [
    ((0.001, 0.01, 0.1), 256, 1 << 15, 500_000, 20), ((0.05, 0.3), 7, 64, 500_000, 5), ((), 256, 100, 500_000, 20), ((0.02,), 10, 128, 3, 20),
])
def test_rank(spark, monkeypatch, tables, owners, bundle, shard, known, k):
    monkeypatch.setattr(ranking, "BUNDLE", bundle)
    monkeypatch.setattr(ranking, "SHARD", shard)
    monkeypatch.setattr(ranking, "FILTER_TERMS", known)
    docs, items = tables
    got = ranking.rank(*frames(spark, docs, items), k=k, owners=owners).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items, k)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("ab cd,É " * 500 + "x" * 50).encode()
    whole = ranking.count_terms(text)
    monkeypatch.setattr(ranking, "CHUNK", 7)
    assert ranking.count_terms(text) == whole == Counter({b"ab": 500, b"cd": 500, "É".encode(): 500, b"x" * 50: 1})


def test_nothing(spark, tables):
    docs, items = frames(spark, *tables)
    assert ranking.rank(docs.limit(0), items).count() == 0
    assert ranking.rank(docs, items.limit(0)).count() == 0
