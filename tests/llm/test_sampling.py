"""Sampled segmentations: distribution, distinctness, inclusion and round trips."""

import tracemalloc
from collections import Counter
from math import exp

import numpy as np
import pyarrow as pa
import pytest

from moundlake.llm import catalogue, sampling

ODD = [
    (1, "The  world  is\nround"), (2, ""), (3, None), (None, "abc"), (5, "é ñ 日 \U0001f600 \U000e0001 x"), (6, "a▁b ▁ c"), (7, "x" * 20_000 + " " * 3_000), (8, "word " * 40_000),
    (8, "word"), (8, "word"),
]


@pytest.fixture(scope="module")
def vocabulary():
    return sampling.Vocabulary()


def all_ways(unit, vocabulary):
    """{pieces: weight} of every segmentation of one unit."""
    known = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.bytes.values() and i > 2}
    if not unit:
        return {(): 1.0}
    out: Counter = Counter()
    for n in range(1, min(len(unit), vocabulary.longest) + 1):
        i = known.get(unit[:n])
        if i is not None:
            for rest, w in all_ways(unit[n:], vocabulary).items():
                out[(i, *rest)] += w * exp(vocabulary.logp[i])
    return out


def test_samples_follow_the_lattice(vocabulary):
    n, text = 30_000, "onts era"
    first, second = (all_ways(u, vocabulary) for u in sampling.units_of(text))
    exact = {a + b: x * y / sum(first.values()) / sum(second.values()) for a, x in first.items() for b, y in second.items()}
    found, after = sampling.Sampler([text] * n, list(range(n)), vocabulary, 5).sample(2)
    tops = Counter(tuple(e[0][0].tolist()) for e in found)
    for ways, p in exact.items():
        assert abs(tops[ways] / n - p) < 5 * (p / n) ** 0.5 + 2e-4
    total = 0.0
    for each, threshold in zip(found, after, strict=True):
        assert len({tuple(p.tolist()) for p, _, _ in each}) == 2 and each[0][2] >= each[1][2] >= threshold
        for pieces, logp, _ in each:
            assert exp(logp) == pytest.approx(exact[tuple(pieces.tolist())])
            total += exp(logp - sampling.log_inclusion(logp, threshold))
    assert total / n == pytest.approx(1.0, abs=0.02)  # inclusion scores weigh the samples to the whole


def test_without_replacement_until_exhausted(vocabulary):
    every = all_ways("▁abcd", vocabulary)
    found, after = sampling.Sampler(["abcd"], [1], vocabulary, 3).sample(len(every) + 5)
    assert {tuple(p.tolist()) for p, _, _ in found[0]} == set(every) and len(found[0]) == len(every) and after == [None]
    assert sum(exp(x) for _, x, _ in found[0]) == pytest.approx(1)


def test_values_do_not_depend_on_the_batch(vocabulary):
    texts = ["one two three", "other words here", ""]
    whole, _ = sampling.Sampler(texts, [4, 5, 6], vocabulary, 1).sample(3)
    for i, t in enumerate(texts):
        alone, _ = sampling.Sampler([t], [4 + i], vocabulary, 1).sample(3)
        assert [(p.tolist(), x, g) for p, x, g in alone[0]] == [(p.tolist(), pytest.approx(x), pytest.approx(g)) for p, x, g in whole[i]]


def test_long_text_walks_in_parts(vocabulary, monkeypatch):
    text = "some words of a text " * 40
    whole, _ = sampling.Sampler([text, "b"], [1, 2], vocabulary, 1).sample(3)
    monkeypatch.setattr(sampling, "WALK", 7)
    parts, _ = sampling.Sampler([text, "b"], [1, 2], vocabulary, 1).sample(3)
    for a, b in zip(whole, parts, strict=True):
        assert [p.tolist() for p, _, _ in a] == [p.tolist() for p, _, _ in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_odd_texts_round_trip(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS samples")
    rows = sampling.encode(docs, k=3).selectExpr("doc_id", "inline(samples)")
    got = Counter((r["doc_id"], r["text"]) for r in sampling.decode(rows).collect())
    assert set(got) == {(i, t or "") for i, t in ODD} and got[2, ""] == 1 and got[8, "word"] == 6
    assert sampling.encode(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [5, None]), (3, [10**6])], "doc_id long, ids array<int>")
    assert [r["text"] for r in sampling.decode(bad).collect()] == [None] * 3


def test_query_decodes_to_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = catalogue.queries()["op6_sampling"](spark, sf_dir)
    rows = sampling.decode(coded.withColumnRenamed("exact", "text")).join(docs.selectExpr("doc_id", "coalesce(text, '') AS original"), "doc_id").collect()
    assert all(r["text"] == r["original"] and r["n_pieces"] == len(r["ids"]) and r["log_inclusion"] <= 0 for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows) > 1.9 * docs.count()
    assert coded.where("NOT exact").count() == 0


def test_lattice_edges_are_all_pieces_in_order(vocabulary):
    """Edges of every character, longest first, with the odds of all ways on to the unit's end; units of several lengths side by side."""
    units = [*sampling.units_of("the onts  era 日x"), "▁", "▁" + "ab" * 40]
    lattice = sampling.Lattices.build(units, vocabulary)
    known = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.bytes.values() and i > 2}
    for unit, start in zip(units, lattice.start.tolist(), strict=True):
        ways = [0.0] * len(unit) + [1.0]
        for at in reversed(range(len(unit))):
            edges = [(n, known.get(unit[at : at + n])) for n in range(min(len(unit) - at, vocabulary.longest), 0, -1)]
            edges = [(n, i if i is not None else -1 - ord(unit[at])) for n, i in edges if i is not None or n == 1]
            weight = [exp(vocabulary.logp[i] if i >= 0 else len(unit[at].encode()) * vocabulary.byte_logp) * ways[at + n] for n, i in edges]
            ways[at] = sum(weight)
            lo = lattice.first[start + at]
            hi = lo + lattice.count[start + at]
            assert list(zip(lattice.length[lo:hi].tolist(), lattice.piece[lo:hi].tolist(), strict=True)) == edges
            assert np.allclose(np.exp(lattice.chance[lo:hi]), np.array(weight) / sum(weight))


def test_lattices_by_parts_are_those_of_each_unit_alone(vocabulary, monkeypatch):
    """Bit by bit: the odds of a unit depend neither on the units beside it nor on the part it is built in."""
    units = list(dict.fromkeys(u for i in range(300) for u in sampling.units_of(f"word{i} the onts  internationalization era{i * 7} 日x {'ab' * (i % 30)}")))
    monkeypatch.setattr(sampling, "BUILD", 500)
    whole = sampling.Lattices.of(units, vocabulary)
    for unit, a, b in zip(units, whole.start.tolist(), whole.end.tolist(), strict=True):
        alone = sampling.Lattices.build([unit], vocabulary)
        assert alone.count.tolist() == whole.count[a:b].tolist() and b - a == len(unit)
        for name in ("length", "piece", "chance", "up_to"):
            mine = [getattr(whole, name)[f : f + n].tolist() for f, n in zip(whole.first[a:b].tolist(), whole.count[a:b].tolist(), strict=True)]
            assert mine == [getattr(alone, name)[f : f + n].tolist() for f, n in zip(alone.first.tolist(), alone.count.tolist(), strict=True)]


def test_what_is_left_aside_weighs_all_other_edges(vocabulary):
    """Also where one edge has nearly all the odds and 1 - p has no digits left."""
    lattice = sampling.Lattices.build(sampling.units_of("internationalization of the things, characteristically"), vocabulary)
    spots = np.flatnonzero(lattice.count > 1)
    for edge in (0, -1):
        first, stop = lattice.first[spots].astype(np.int64), lattice.first[spots].astype(np.int64) + lattice.count[spots]
        taken = first if edge == 0 else stop - 1
        expected = [sum(exp(lattice.chance[e]) for e in range(a, b) if e != t) for a, b, t in zip(first, stop, taken, strict=True)]
        assert np.allclose(np.exp(lattice.others(spots, taken)), expected, rtol=1e-6, atol=0)
    assert lattice.others(spots, lattice.first[spots].astype(np.int64)).min() < -16


def test_words_are_split_as_units():
    for text in ("", " ", "a", "a ", " a", "a  b", "a b  ", "a▁b c", "▁", "a \n b", "x\ty z "):
        assert [sampling.SPACE + u for u in sampling.bare_units_of(text)] == sampling.units_of(text)


def test_memory_of_a_slice_is_bounded(spark, sf_dir, monkeypatch):
    """Arrays alive at once for a slice of the query stay under 30 MB, whatever the batch holds."""
    taken = {}
    monkeypatch.setattr(sampling, "in_batches", lambda rows, work, schema, max_bytes: taken.update(work=work, most=max_bytes))
    sampling.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(taken["most"] // 10)]  # no word twice: the most lattices
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(words)]})
    list(taken["work"](batch))
    tracemalloc.start()
    list(taken["work"](batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6, peak
