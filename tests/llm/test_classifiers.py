"""Quality and toxicity scores: held-out accuracy, odd inputs, and the parts of the models."""

import itertools

import numpy as np
import pytest

from moundlake.llm import catalogue, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "word " * 60_000), (3, "word"), (None, "idiot"), (5, "\x00 !! || é")]


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    scored = catalogue.queries()[name](spark, SF).toPandas()
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()
    both = scored.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 20 and (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("score", [quality.score, toxicity.score])
def test_odd_rows(spark, score):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS row")
    for labels in ([(1, 0, 0), (3, 1, 1), (3, 0, 1), (None, 1, 1), (5, None, None)], []):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert score(docs, known).count() == len(ODD)
        assert score(docs.limit(0), known).count() == 0
    rows = toxicity.score(docs, known).collect()
    assert sorted((r["row"]["doc_id"] or -1, r["row"]["text"] or "", r["row"]["score"]) for r in rows) == sorted((i or -1, t or "", 1) for i, t in ODD)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=10, pairs=1)
    assert list(model.pairs) == [(0, 1)] and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_features_of_kinds():
    shout, bars, prose = quality.features(b"AB!! CD!! EF!!"), quality.features(b"ab | cd | ef"), quality.features(b"ab cd. Ef")
    at = quality.FEATURES.index
    assert shout[at("shouts")] == 2 > prose[at("shouts")] and bars[at("bars")] > 0 and quality.features(b"a a a b")[at("repeats")] == 0.5
    assert quality.features(b"") == [0.0] * len(quality.FEATURES)


def test_disguised_words_are_restored(spark):
    words = "idiot moron the other line of words is plain trash clown stupid people stop then it ended".split()
    docs = spark.createDataFrame([(" ".join(words * 30),)], "text string")
    decoder = toxicity.Decoder(toxicity.letter_counts(docs))
    found = toxicity.words_of(b"You 1d10t, m o r o n! s-t-u-p-i-d cl0wn traaaash tr*sh (2024) a1", decoder)
    assert {b"idiot", b"moron", b"stupid", b"clown", b"trash"} <= set(found)


@pytest.mark.parametrize(("text", "words"), [
    ("an iiddiioott", {"idiot"}), ("mo" + "r" * 80 + "on", {"moron"}), ("so m  o  r  o  n now", {"moron"}), ("m\no\nr\no\nn", {"moron"}),
    ("a m o r o n", {"a", "moron"}), ("y o u i d i o t", {"you", "idiot"}), ("y-o-u s.t.u.p.i.d", {"stupid"}), ("his a$$", {"ass"}), ("hat3 1234", {"hate"}),
    ("x " + "m o r o n " * 300, {"moron"}),
])
def test_disguises_of_any_length_and_spacing(decoder, text, words):
    assert words <= set(w.decode() for w in toxicity.words_of(text.encode(), decoder))


@pytest.fixture(scope="module")
def decoder(spark):
    words = "you are an idiot and a moron the other line of words is plain his ass they hate trash clown stupid people stop then it ended".split()
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(" ".join(rng.choice(words, 2000)),)], "text string")
    return toxicity.Decoder(toxicity.letter_counts(docs))


@pytest.mark.parametrize("token", ["1d10t", "iiddiioott", "m o  r o", "a$$", "s s s o", "t rr0", "x", "8 8a", "h4!+3", "a a"])
def test_viterbi_equals_enumeration(decoder, token):
    def score(text, cost):
        codes = [0, 0, *(0 if c == " " else ord(c) - 96 for c in text), 0]
        return cost + sum(decoder.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    every = {}
    for path in itertools.product(*toxicity.lattice(token)):
        text, value = "".join(x for x, _ in path), sum(c for _, c in path)
        every[text] = max(score(text, value), every.get(text, -np.inf))
    best = max(every.values())
    assert every[decoder.decode(token)] == pytest.approx(best)


def test_tokens_with_marks():
    assert toxicity.disguised(b"all plain 1234 w0rd! x") == {"all", "w0rd"} and toxicity.disguised(b"") == set()
    assert toxicity.disguised(b"a  b\tc 7 7 7") == {"a  b c 7 7 7"} and toxicity.disguised(b"7 7 7") == set()
    long = "ab0" * 30_000
    assert toxicity.disguised(long.encode()) == {long}


def test_near_copies_make_no_clue(spark):
    copy = "zork blit " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"{i} start {copy}", 1) for i in range(40)] + [(100 + i, f"fine text {i} of plain words", 0) for i in range(200)]
    rows += [(400 + i, f"fine text {chr(97 + i)}{i} plain{chr(97 + i)} vermin and words", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs, "doc_id", "text", "toxic", 4, 2, 1000, 1000)
    assert b"vermin." in model.weights and b"zork." not in model.weights


def test_texts_behind_one_header_all_teach(spark):
    header = " ".join(f"header{chr(97 + i)}" for i in range(18))
    rows = [(i, f"{header} fine{chr(97 + i % 26)} text{i} plain{chr(97 + i % 25)} vermin and words", 1) for i in range(40)]
    rows += [(100 + i, f"{header} fine text {i} of plain words", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert b"vermin." in toxicity.learn(docs, docs, "doc_id", "text", "toxic", 4, 2, 1000, 1000).weights
