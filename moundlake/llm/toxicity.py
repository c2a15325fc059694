"""Toxicity scores of texts whose disguised words are restored by a noisy-channel decoder."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.llm.common import clean_texts, crc_bucket, cut_lineage, in_batches, label_sample

# Letters a sign can stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
SIGNS = re.escape("".join(LEET))
LETTERS = 28  # word boundary, a to z, any other letter
SPACED = re.compile(rf"(?<![a-z0-9])[a-z{SIGNS}](?:[\s._*-]+[a-z{SIGNS}]){{2,}}(?![a-z0-9])".encode())
BETWEEN = re.compile(rb"[\s._*-]+")
LETTER = re.compile(rb"[a-z]")
JOINED = re.compile(rb"(?<![a-z])[a-z]+(?:[._*-][a-z]+)+(?![a-z])")
# What a byte of a lower-cased text can be in a token: 1 a letter, 2 a sign for one, 0 neither.
KIND = np.array([1 if 97 <= c < 123 else 2 if chr(c) in LEET else 0 for c in range(256)], dtype=np.uint8)
# Everything but letters parts words; bytes above 127 belong to letters here.
PLAIN = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c > 127 else 32 for c in range(256))
CODES = np.array([c - 96 if 97 <= c < 123 else 27 if c > 127 else 0 for c in PLAIN], dtype=np.int32)
# Log-probabilities of the channel: a sign used as a letter, a letter written again, a gap wider than usual inside a word, the end
# of a word at any other gap between letters.
SWAP_COST, REPEAT_COST, WIDE_COST, SPLIT_COST = log(0.2), log(0.3), log(0.1), log(0.1)
# Tokens longer than this are decoded each time they come up.
REMEMBERED = 64
PREFIXES = (4, 5, 6, 7, 8)
INPUTS = 6
# A word counts this often in one text at most, so that repetition isn't taken for spread.
TIMES = 3
# The score of every text where there are no labels to learn from.
UNTAUGHT = 0.1


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``[28, 28, 28]`` counts of letter trigrams over whole texts; runs of word boundaries count once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                code = CODES[np.frombuffer(b" " + text + b" ", np.uint8)]
                code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]
                if len(code) > 2:
                    counts += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["at", "n"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    out = np.zeros(LETTERS**3)
    for row in texts.mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 28^3 rows
        out[row["at"]] = row["n"]
    return out.reshape(LETTERS, LETTERS, LETTERS)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of one character of ``token`` can mean, with its cost; letters that can mean one thing only go together.

    A run is one letter or a double one, whatever its length. Letters parted by gaps (spaces, as many as
    the gap is wide) may belong to one word or to two; a gap wider than the usual one hints at two.
    """
    runs: list[list] = []  # character, times, gap before the run, any gap inside
    gap = usual = 0
    if " " in token:
        widths = Counter(len(g) for g in re.findall(" +", token))
        usual = max(widths, key=lambda w: (widths[w], -w), default=0)
    for c in token:
        if c == " ":
            gap += 1
        elif runs and runs[-1][0] == c:
            runs[-1][1] += 1
            runs[-1][3] |= gap > 0
            gap = 0
        else:
            runs.append([c, 1, gap, False])
            gap = 0
    steps: list[list] = []
    for c, times, before, parted in runs:
        if times == 1 and not before and c not in LEET:  # letters that mean themselves go together
            if steps and len(steps[-1]) == 1 and len(steps[-1][0][0]) < REMEMBERED:
                steps[-1] = [(steps[-1][0][0] + c, 0.0)]
            else:
                steps.append([(c, 0.0)])
            continue
        again = REPEAT_COST if times > 1 else 0.0
        pieces = []
        for x in LEET.get(c, c):
            cost = SWAP_COST if c in LEET else 0.0
            pieces.append((x, cost + again))
            if times > 1:  # two or more can mean a double letter, or the end of a word and the start of the next
                double = 2 * cost + (REPEAT_COST if times > 2 else 0.0)
                pieces.append((x + x, double))
                if parted:
                    pieces.append((f"{x} {x}", double + SPLIT_COST))
                    if times > 2:
                        pieces.append((f"{x}{x} {x}", double + cost + SPLIT_COST))
        if before:
            whole, split = (WIDE_COST, 0.0) if before > usual else (0.0, SPLIT_COST)
            pieces = [way for x, cost in pieces for way in ((x, cost + whole), (" " + x, cost + split))]
        steps.append(pieces)
    return steps


class Decoder:
    """Viterbi decoding of one disguised token, or run of spaced letters, under a letter trigram model."""

    def __init__(self, counts: np.ndarray):
        one = counts.sum(axis=(0, 1)) + 1
        two = counts.sum(axis=0) + 2 * (one / one.sum())[None, :]
        two /= two.sum(axis=1, keepdims=True)
        three = counts + 5 * two[None, :, :]
        self.log = np.log(three / three.sum(axis=2, keepdims=True)).tolist()
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """``decode``, remembering the tokens of late."""
        if len(token) > REMEMBERED:
            return self.decode(token)
        if token not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[token] = self.decode(token)
        return self.known[token]

    def decode(self, token: str) -> str:
        """The likeliest words behind ``token``, a text of letters, LEET signs and gaps, in time linear in its length."""
        table = self.log
        states: dict = {(0, 0): (0.0, None)}  # the last two letters: score, text so far as a chain of pieces
        for pieces in lattice(token):
            pieces = [(x, cost, [c & 31 for c in x.encode()]) for x, cost in pieces]  # a space is 0, a is 1
            after: dict = {}
            for (a, b), (score, chain) in states.items():
                for x, cost, codes in pieces:
                    p, q, value = a, b, score + cost
                    for n in codes:
                        value += table[p][q][n]
                        p, q = q, n
                    if (p, q) not in after or value > after[p, q][0]:
                        after[p, q] = (value, (chain, x))
            states = after
        chain = max(((score + self.log[a][b][0], chain) for (a, b), (score, chain) in states.items()), key=lambda s: s[0])[1]
        out = []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))


def disguised(low: bytes) -> set[str]:
    """Tokens of a lower-cased text that may hide words: with signs for letters, letters written again, or letters apart.

    Whole tokens and runs of any length; tokens without any letter are taken as numbers.
    """
    found = set()
    kind = KIND[np.frombuffer(b" " + low + b" ", np.uint8)]
    inside = kind > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # in places of ``low``: starts and ends in turn
    codes = np.frombuffer(low, np.uint8)
    marks = kind[1:-1] == 2
    marks[:-1] |= (codes[1:] == codes[:-1]) & (kind[1:-2] == 1)
    at = np.unique(np.searchsorted(edges[::2], np.flatnonzero(marks), side="right") - 1)
    tokens = {low[a:b].strip(b"!|+") for a, b in zip(edges[2 * at].tolist(), edges[2 * at + 1].tolist(), strict=True)}
    found.update(t.decode() for t in tokens if LETTER.search(t))
    for m in SPACED.finditer(low):
        if LETTER.search(m.group()):
            found.add(BETWEEN.sub(lambda g: b" " * len(g.group()), m.group()).decode())
    return found


def words_of(text: bytes, decoder: Decoder) -> list[bytes]:
    """Words of a whole text in order, then those restored from disguise."""
    words = text.translate(PLAIN).split()
    low = text.lower()
    known = {*words}
    restored = {w for t in disguised(low) for w in decoder.restore(t).encode().split()} | {re.sub(rb"[._*-]", b"", m.group()) for m in JOINED.finditer(low)}
    return words + sorted(restored - known)


def clues(word: bytes) -> list[bytes]:
    """The word, marked by a full stop, and its first letters, so that a stem is known under unseen endings."""
    return [word + b".", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights of clues (log ratio of their rates in toxic and other texts) and a logistic model of a text's hits."""

    weights: dict[bytes, float]
    decoder: Decoder
    coefficients: np.ndarray

    def inputs(self, text: bytes) -> list[float]:
        """Constant, heaviest hit, sum of hits, length; each word counts by its heaviest clue."""
        words = words_of(text, self.decoder)
        starts = self.starts()
        hits = []
        for word, times in Counter(w for w in words if w[:4] in starts).items():
            weight = max((self.weights.get(c, 0.0) for c in clues(word)), default=0.0)
            hits += [weight] * min(times, TIMES)
        total, size = sum(hits), len(words)
        return [1.0, max(hits, default=0.0), float(np.log1p(total)), float(np.log1p(size)), float(np.sqrt(total)), total / (size + 20.0)]

    def starts(self) -> set[bytes]:
        if "_starts" not in self.__dict__:
            self._starts = {c[:4] if c[-1:] != b"." else c[:-1][:4] for c in self.weights}
        return self._starts

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.coefficients, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton steps on the penalised log-likelihood; the first column, the constant, isn't penalised."""
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int, max_labels: int, max_clues: int
) -> Model:
    train = lambda i: crc_bucket(i, folds) != held_out_fold
    decoder = Decoder(letter_counts(docs.where(train(F.col(f"`{id_col}`"))), text_col))
    sample = label_sample(labels, label_col, id_col, train, max_labels)
    texts = clean_texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    # copies teach once: of labelled texts that are alike but for case and white space the one with the least id
    content = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    kept = texts.groupBy(content.alias("content"), "label").agg(F.min("doc_id").alias("doc_id"))
    taught = cut_lineage(texts.join(F.broadcast(kept.select("doc_id", "label")), ["doc_id", "label"]).select(F.col("text").cast("binary").alias("text"), "label"))

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        seen, contexts, sizes = (Counter(), Counter()), Counter(), [0, 0]
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = words_of(text, decoder)
            sizes[label] += len(words)
            for word, times in Counter(words).items():
                for c in clues(word):
                    seen[label][c] += min(times, TIMES)
            if label:
                for before, word in zip([b"", *words], words, strict=False):
                    for c in clues(word):
                        contexts[c] |= 1 << crc32(before) % 63
        keys = list(seen[0].keys() | seen[1].keys())
        yield {"clue": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys], "contexts": [contexts[k] for k in keys]}
        yield {"clue": [b""], "toxic": [sizes[1]], "clean": [sizes[0]], "contexts": [0]}

    counted = (
        in_batches(taught, count, "clue binary, toxic long, clean long, contexts long", max_bytes=4 << 20)
        .groupBy("clue").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))
    )
    counted = cut_lineage(counted.where("clue = X'' OR toxic >= 4"))
    words = counted.where("clue = X''").first()
    toxic, clean = (words["toxic"], words["clean"]) if words else (0, 0)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    texts_n = taught.where("label = 1").count()
    # copies of one toxic text share their contexts; a clue must stand after several different words
    best = (
        counted.where("clue <> X''").where(F.col("toxic") >= max(4, round(0.004 * texts_n))).where(F.bit_count("contexts") >= 4)
        .withColumn("weight", weight).where("weight >= 1.5")
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "clue").limit(max_clues).collect()
    )
    model = Model({bytes(r["clue"]): r["weight"] for r in best}, decoder, np.append(log(UNTAUGHT / (1 - UNTAUGHT)), np.zeros(INPUTS - 1)))

    def inputs(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"x": [model.inputs(t) for t in batch.column("text").to_pylist()], "label": batch.column("label")}

    rows = in_batches(taught, inputs, "x array<double>, label int", max_bytes=4 << 20).toArrow()  # at most about max_labels rows
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, INPUTS)
    if len(y) and y.min() < y.max():
        model.coefficients = logistic(x, y)
    elif len(y):
        model.coefficients = np.append(log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(INPUTS - 1))
    return model


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 4, held_out_fold: int = 2, threshold: float = 0.3, max_labels: int = 20_000, max_clues: int = 4_000, carry_text: bool = True,
) -> DataFrame:
    """``(row, held_out, score, predicted)``, one row per input row; ``row`` holds the input columns, without the text if so asked.

    A letter trigram model is counted over all whole texts outside the held-out fold. Words that
    hide behind signs, repetition or spacing (any run of white space and of ``._*-`` between single letters,
    split into words where the letters say so) are decoded over a lattice of the letters each
    sign can mean; tokens without a letter are numbers. The words of the restored text and their beginnings are looked up among
    clues (the ``max_clues`` heaviest) learnt from about ``max_labels`` labelled documents at most (those alike but for case
    and white space teach once), and a logistic model of the hits gives the score. Nothing is shuffled to score.

    Defined cases: null and empty texts are scored as texts without hits; very long texts, tokens and runs are read
    whole, in time linear in their length; without labels all
    scores are 0.1, with one class only all are alike; null ids are scored and never train; rows
    come back as often as they went in; an empty table gives no rows; input columns live inside ``row``.
    """
    model = learn(docs, labels, id_col, text_col, label_col, folds, held_out_fold, max_labels, max_clues)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    packed = docs.select(
        F.struct(*others, F.lit(0).alias("no column")).alias("rest"), F.col(f"`{id_col}`").cast("long").alias("id"), text.cast("binary").alias("text")
    )
    kept = ["rest", "id", "text"] if carry_text else ["rest", "id"]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = np.array([model.inputs(t or b"") for t in batch.column("text").to_pylist()]).reshape(-1, INPUTS)
        yield {c: batch.column(c) for c in kept} | {"score": model.score(rows)}

    schema = packed.select(*kept).withColumn("score", F.lit(0.0)).schema
    scored = in_batches(packed, work, schema)
    inputs = [
        F.col("text").cast("string").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns if carry_text or c != text_col
    ]
    return scored.select(
        F.struct(*inputs).alias("row"), (crc_bucket("id", folds) == held_out_fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
