"""Secret scans over a trigram index: Boolean trigram queries choose the texts that a rule is tried on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundlake.llm.common import clean_texts, in_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a byte pattern, and the least length of its match or of one of its groups."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


# The kinds of secrets, in the order that breaks ties of equal starts.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# A set of exact strings is cut off when it has more members; the trigrams so far stay mandatory.
MOST_STRINGS = 64

# A query is True, a trigram, ("and", queries) or ("or", queries).


def trigram_query(rule: Rule):
    """The Boolean trigram query that every text with a match of ``rule`` fulfils, over lower-cased text; True if there is none."""
    texts, needs = sequence(list(sre_parse.parse(rule.pattern)))
    return simplify("and", needs if texts is None else [*needs, of_strings(texts)])


def simplify(kind: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: set[str]):
    """One of ``strings`` occurs: an OR over the ANDs of their trigrams; an AND that another one implies is left out."""
    each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    each = [a for a in each if not any(b < a for b in each)]
    return simplify("or", [simplify("and", sorted(a)) for a in sorted(each, key=sorted)])


def sequence(nodes: list) -> tuple[set[str] | None, list]:
    """Of consecutive parts of a pattern: all texts they match, or None when those are too many, and the queries that must hold."""
    run, exact, needs = {""}, True, []
    for op, arg in nodes:
        texts, own = texts_of(op, arg)
        needs += own
        longer = None if texts is None else {a + b for a in run for b in texts}
        if longer is None or len(longer) > MOST_STRINGS:
            needs.append(of_strings(run))
            exact, run = False, {""}
            if texts is not None:
                run = texts
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                pass
        else:
            run = longer
    if exact:
        return run, needs
    return None, [*needs, of_strings(run)]


def texts_of(op, arg) -> tuple[set[str] | None, list]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, []
    if op is sre.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, []
        return (found, []) if len(found) <= 8 else (None, [])
    if op is sre.SUBPATTERN:
        texts, needs = sequence(list(arg[3]))
        return (texts, needs) if texts is not None else (None, needs)
    if op is sre.BRANCH:
        each = [sequence(list(x)) for x in arg[1]]
        if all(texts is not None for texts, _ in each):
            return set().union(*(texts for texts, _ in each)), []
        return None, [simplify("or", [simplify("and", n if t is None else [*n, of_strings(t)]) for t, n in each])]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, part = arg
        texts, needs = sequence(list(part))
        if (least, most) == (0, 1) and texts is not None:
            return texts | {""}, []
        return None, needs if least else []
    return (set() if op is sre.AT else None), []


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Postings of the trigrams that some rule asks for, over one block of texts, as one bitmap a trigram."""

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def __init__(self, wanted: list[str]):
        self.number = {t: k for k, t in enumerate(wanted)}
        self.pairs = np.zeros(1 << 16, bool)
        self.codes = np.array([int.from_bytes(t.encode(), "big") for t in wanted], dtype=np.uint32)
        self.pairs[self.codes >> 8] = True
        self.order = np.argsort(self.codes)

    def postings(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``[trigram, text]``; ``starts`` holds the first byte of each text and the end of the last."""
        found = np.zeros((len(self.codes), len(starts) - 1), bool)
        low = self.lower[data]
        if len(low) < 3 or not len(self.codes):
            return found
        pair = low[:-2].astype(np.uint16) << 8 | low[1:-1]
        at = np.flatnonzero(self.pairs[pair])
        code = pair[at].astype(np.uint32) << 8 | low[at + 2]
        place = np.minimum(np.searchsorted(self.codes, code, sorter=self.order), len(self.order) - 1)
        number = self.order[place]
        text = np.searchsorted(starts, at, side="right") - 1
        real = (self.codes[number] == code) & (at + 2 < starts[text + 1])
        found[number[real], text[real]] = True
        return found

    def matching(self, query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.number[query]]
        each = [self.matching(q, postings) for q in query[1]]
        return np.logical_and.reduce(each) if query[0] == "and" else np.logical_or.reduce(each)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, from its first text on, and where each text starts."""
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    starts = starts[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), starts - (starts[0] if len(starts) else 0)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, spans)``: all matches of ``rules`` in whole texts, an array of (kind, start, end) by start, then rule.

    Per kind the matches are leftmost and don't overlap; those under the least length are
    dropped after matching. Offsets are code points, the end is exclusive. Each block of
    texts (one slice of an input partition) gets postings of the trigrams the rules ask for; a
    rule's Boolean query over the postings gives its candidates, which the pattern verifies. A
    rule without a mandatory trigram is tried on every text. Nothing is shuffled, and a lost
    task is simply run again.

    Defined cases: null and empty texts have no spans; rows come back as often as they went
    in, null ids too; an empty table gives no rows.
    """
    queries = [trigram_query(r) for r in rules]
    wanted = sorted(set().union(*map(trigrams_in, queries)))
    sources = [(r.kind, r.pattern.encode(), re.IGNORECASE if r.any_case else 0, r.group, r.least) for r in rules]
    state: dict = {}

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        if not state:
            state["index"] = TrigramIndex(wanted)
            state["rules"] = [(k, re.compile(p, f), g, n) for k, p, f, g, n in sources]
        index, texts = state["index"], batch.column("text")
        postings = index.postings(*buffers(texts))
        spans: list[list] = [[] for _ in range(len(texts))]
        for order, ((kind, pattern, group, least), query) in enumerate(zip(state["rules"], queries, strict=True)):
            for i in np.flatnonzero(index.matching(query, postings)).tolist():
                text = texts[i].as_py()
                for m in pattern.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        spans[i].append((m.start(), order, kind, m.end()))
        out = []
        for i, found in enumerate(spans):
            found.sort()
            if found:
                text = texts[i].as_py()
                plain = text.isascii()
                place = (lambda at: at) if plain else (lambda at, t=text: len(t[:at].decode("utf-8", "replace")))
                found = [{"kind": k, "start": place(a), "end": place(b)} for a, _, k, b in found]
            out.append(found)
        yield {"doc_id": batch.column("doc_id"), "spans": out}

    rows = clean_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return in_batches(rows, work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def listed(spans: str | Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    col = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def of_kinds(kinds: list[str], spans: str = "spans") -> Column:
    return F.filter(F.col(spans), lambda s: s.kind.isin(kinds))
