"""Sampled SentencePiece segmentations without replacement, and their decoding."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from math import exp, log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.llm.common import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Stands for a literal SPACE sign in a text; a lone surrogate can't occur in UTF-8.
LITERAL = "\udc81"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
# Units walked at a time, which bounds the memory of a walk whatever the length of a text.
WALK = 1 << 13
# Units walked with all branches before looking whether further branches can matter, and how far (in
# log-probability) under the branches already kept they can't: the odds are exp(-DEEP), below rounding.
BLOCK, DEEP = 96, 42.0
# Characters whose lattices are built at a time: their arrays fit a core's cache.
BUILD = 1 << 15
# Log-probability over which the odds of the other edges are added up one by one.
NEAR_ONE = -1e-6
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(0x9E3779B97F4A7C15 * 32 & (1 << 64) - 1)  # the step from a place to the next, which has up to 32 draws
# The draws at a place: which edge inherits the value, the value of the others; when those are taken up, which of them inherits it and what is left.
_, ASIDE, TAKEN_UP, LEFT = (np.uint64(0x9E3779B97F4A7C15 * j & (1 << 64) - 1) for j in range(4))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """A value between 0 and 1 for each number."""
    x = mix(x)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def gumbel(x: np.ndarray) -> np.ndarray:
    """A Gumbel value for each number."""
    return -np.log(-np.log(uniform(x)))


def below(limit, centre, draw):
    """A Gumbel value around ``centre`` conditioned to lie below ``limit``, for a draw between 0 and 1."""
    return -np.logaddexp(-limit, np.log(-np.log(draw)) - centre)


def salt_of(turn: int) -> np.uint64:
    return np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


class Vocabulary:
    """Pieces with their log-probabilities, found by a hash of their characters.

    The model file ranks its pieces; the probability of rank r is taken as proportional to
    1 / (r + 1), and ``alpha`` sharpens (over 1) or flattens it. Bytes, which stand for characters
    without a piece, rank last.
    """

    SLOTS = 20  # bits of the hash table

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.longest = max(len(self.pieces[i]) for i in plain)
        first, total = plain[0], sum(1 / (r + 1) for r in range(n))
        self.logp = alpha * -np.log((np.maximum(np.arange(n) - first, 0) + 1) * total)
        self.byte_logp = float(alpha * -np.log(n * total))
        hashes = np.array([self.hash_of(self.pieces[i]) for i in plain], dtype=np.uint64)
        self.keys, self.ids = np.zeros((1 << self.SLOTS) + 64, np.uint64), np.full((1 << self.SLOTS) + 64, -1, np.int32)
        self.tries, self.begins = 1, np.zeros(1 << self.SLOTS, bool)
        heads = {self.pieces[i][:n] for i in plain for n in range(1, len(self.pieces[i]) + 1)}
        self.begins[self.slots(np.array([self.hash_of(x) for x in heads], dtype=np.uint64))] = True
        for h, at, i in zip(hashes.tolist(), self.slots(hashes).tolist(), plain, strict=True):
            step = 0
            while self.ids[at + step] >= 0:
                step += 1
            self.keys[at + step], self.ids[at + step] = h, i
            self.tries = max(self.tries, step + 1)

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(FACTOR) + ord(c) + 1) & (1 << 64) - 1
        return h

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each hash or -1, and whether a piece may begin so."""
        at, out = self.slots(hashes), np.full(len(hashes), -1, np.int32)
        open_ = self.begins[at]
        left = np.flatnonzero(open_)  # a piece is a beginning of itself
        at, wanted = at[left], hashes[left]
        for _ in range(self.tries):
            ids = self.ids[at]
            hit = (self.keys[at] == wanted) & (ids >= 0)
            out[left[hit]] = ids[hit]
            more = np.flatnonzero(~hit & (ids >= 0))  # an empty place ends a chain
            left, at, wanted = left[more], at[more] + 1, wanted[more]
        return out, open_

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the space put before the text goes."""
        values = self.byte_values()
        out: list[bytes] = [values[i] for i in ids]
        return b"".join(out).decode("utf-8", "replace")[1:]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of segmentations laid end to end, and how many each piece has."""
        if "_spelt" not in self.__dict__:
            values = self.byte_values()
            self._spelt = np.frombuffer(b"".join(values), np.uint8), np.array([len(x) for x in values])
        spelt, size = self._spelt
        begin, sizes = size.cumsum() - size, size[ids]
        parts = [spelt[ranges(begin[ids[a : a + WALK]], sizes[a : a + WALK])] for a in range(0, len(ids), WALK)]
        return np.concatenate([*parts, np.zeros(0, np.uint8)]), sizes

    def byte_values(self) -> list[bytes]:
        if "_values" not in self.__dict__:
            self._values = [p.replace(SPACE, " ").encode() for p in self.pieces]
            for b, i in self.bytes.items():
                self._values[i] = bytes([b])
        return self._values


def units_of(text: str) -> list[str]:
    """Runs of spaces with what follows; no piece reaches from one into the next."""
    return UNIT.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))


def bare_units_of(text: str) -> list[str]:
    """``units_of`` without the space that each begins with."""
    if text.startswith(" ") or "  " in text or SPACE in text:
        return [u[1:] for u in units_of(text)]
    return text.split(" ")


@dataclass
class Lattices:
    """The lattices of some distinct units, side by side: edges by starting character, with log-probabilities.

    ``chance`` is the probability of an edge given that its start is reached, so the edges of
    a start add up to one and a walk along them is a sample of the unit's segmentations.
    """

    start: np.ndarray  # first character of each unit
    end: np.ndarray
    first: np.ndarray  # of each character its first edge
    count: np.ndarray  # and the number of its edges
    length: np.ndarray  # characters of each edge
    piece: np.ndarray  # its piece, or -1 - code point for bytes
    chance: np.ndarray
    up_to: np.ndarray  # probability of the edge and those of its start before it

    @classmethod
    def of(cls, units: list[str], vocabulary: Vocabulary) -> Lattices:
        """The lattices of any number of units, built by parts."""
        tops = np.cumsum([len(u) for u in units], dtype=np.int64)
        cuts = np.unique(np.append(np.searchsorted(tops, np.arange(0, tops[-1], BUILD)), len(units))).tolist() if units else [0, 0]
        parts = [cls.build(units[a:b], vocabulary) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        chars, edges = (np.cumsum([0, *(len(getattr(p, name)) for p in parts)]).tolist() for name in ("first", "length"))
        for part, c, e in zip(parts, chars, edges, strict=False):
            part.start += c
            part.end += c
            part.first += np.int32(e)
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    @classmethod
    def build(cls, units: list[str], vocabulary: Vocabulary) -> Lattices:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.array([len(u) for u in units], dtype=np.int64)
        end = lens.cumsum()
        start = end - lens
        left = np.repeat(end, lens) - np.arange(len(codes))  # characters to the unit's end
        where, rank, piece, weight = [], [], [], []
        count, following = np.zeros(len(codes), np.int8), codes + np.uint64(1)
        now, at = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        for n in range(1, vocabulary.longest + 1):
            if not len(at):
                break
            now *= FACTOR
            now += following[at + (n - 1)]
            found, more = vocabulary.find(now)
            if n == 1:  # a character without a piece goes by its bytes, so each has an edge
                code = np.where(codes == ord(LITERAL), ord(SPACE), codes).astype(np.int64)
                size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                spots, pieces = at, np.where(found >= 0, found, -1 - code)
                weights = np.where(found >= 0, vocabulary.logp[found], size * vocabulary.byte_logp)
            else:
                hit = np.flatnonzero(found >= 0)
                spots, pieces = at[hit], found[hit]
                weights = vocabulary.logp[pieces]
            where.append(spots)
            rank.append(count.take(spots))
            count[spots] = rank[-1] + np.int8(1)
            piece.append(pieces)
            weight.append(weights)
            go = np.flatnonzero(more & (left[at] > n))
            at, now = at.take(go), now.take(go)
        # characters nearest to the end first (short numbers sort by radix), edges by character, longest first: mostly the likeliest
        ring = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        many = count.take(ring)
        heads = many.cumsum() - many
        first = np.zeros(len(codes), np.int32)
        first[ring] = heads
        edges, last = int(many.sum()), first + count - 1
        length, pieces, weights = np.zeros(edges, np.int8), np.zeros(edges, np.int32), np.zeros(edges)
        for n, (spots, ranks, values, logs) in enumerate(zip(where, rank, piece, weight, strict=True), 1):
            place = last.take(spots) - ranks
            length[place], pieces[place], weights[place] = n, values, logs
        del where, rank, piece, weight
        where = np.repeat(ring, many)
        # log-probability of all ways from a character to its unit's end; the end itself has the extra place
        ways, chance = np.zeros(len(codes) + 1), np.zeros(edges)
        onto = np.where(left.take(where) > length, where + length, len(codes))
        del where
        rings = np.append(0, np.bincount(left, minlength=1)[1:].cumsum()) if len(left) else np.zeros(1, np.int64)
        for a, b in zip(rings[:-1].tolist(), rings[1:].tolist(), strict=True):
            lo, hi = heads[a], heads[b] if b < len(heads) else edges
            each, cuts = weights[lo:hi] + ways.take(onto[lo:hi]), heads[a:b] - lo
            top = np.maximum.reduceat(each, cuts)
            all_ways = top + np.log(np.add.reduceat(np.exp(each - np.repeat(top, many[a:b])), cuts))
            ways[ring[a:b]] = all_ways
            chance[lo:hi] = each - np.repeat(all_ways, many[a:b])
        up_to, rest = np.exp(chance), np.flatnonzero(many > 1)
        for n in range(1, int(count.max(initial=1))):  # summed start by start, so that rounding doesn't depend on other units
            at = heads.take(rest) + n
            up_to[at] += up_to.take(at - 1)
            rest = rest[many.take(rest) > n + 1]
        if len(heads):
            up_to[np.append(heads[1:], edges) - 1] = 2.0  # so the last edge takes the rest
        return cls(start, end, first, count, length, pieces, chance, up_to)

    def others(self, spot: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Log of the probability of all edges of a character but one."""
        chance = self.chance.take(edge)
        close = np.flatnonzero(chance > NEAR_ONE)  # 1 - p has no digits there
        out = np.log1p(-np.exp(np.minimum(chance, NEAR_ONE)))
        if len(close):
            count = self.count[spot[close]]
            every = ranges(self.first[spot[close]], count)
            odds = np.exp(self.chance[every])
            odds[every == np.repeat(edge[close], count)] = 0
            with np.errstate(divide="ignore"):
                out[close] = np.log(np.add.reduceat(odds, count.cumsum() - count))
        return out

def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = count.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


@dataclass
class Walk:
    """Segmentations, one a text: pieces by place, and the best branches that were left aside.

    A branch is all edges of a character but some: its value is the largest of their leaves.
    """

    place: list[np.ndarray]
    piece: list[np.ndarray]
    logp: np.ndarray
    branches: list[list[tuple]]  # per text: (value, place, text unit, character, log-probability of reaching it, edges that are taken)


class Sampler:
    """Top-k segmentations of the texts of one slice by Gumbel values drawn top down.

    A text's segmentations are the leaves of a tree that adds a piece at a time. The value of a
    node is the largest of its leaves; which child inherits it is independent of it, and the largest
    value of the other children together is a Gumbel value conditioned to lie below. So the search always goes
    down where the value is inherited, with one draw more for all that is left aside at a place, and takes up
    the best branch left aside next: leaves come in the order of their values, without repeats.
    """

    def __init__(self, texts: list[str], keys: list[int], vocabulary: Vocabulary, seed: int):
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__  # a new unit gets the next number
        each = [np.fromiter(map(known.__getitem__, units), np.int64, len(units)) for units in map(bare_units_of, texts)]
        self.lattices = Lattices.of([SPACE + u for u in known], vocabulary)
        self.units = np.concatenate([*each, np.zeros(0, np.int64)])
        self.first = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
        sizes = (self.lattices.end - self.lattices.start)[self.units]
        self.offset = sizes.cumsum() - sizes  # of each unit its first character, counted over the slice
        self.opening = self.offset[self.first[:-1]]  # of each text
        base = np.array([k & (1 << 64) - 1 for k in keys], dtype=np.uint64)
        self.seeds = mix(base + mix(np.array([seed], dtype=np.uint64)))

    def walk(self, who: np.ndarray, unit: np.ndarray, at: np.ndarray, logp: np.ndarray, value: np.ndarray, turn: int, keep: int, floor: np.ndarray) -> Walk:
        """Go on for the texts ``who`` from character ``at`` (of the lattice) of their text unit ``unit``.

        Only the ``keep`` best branches over ``floor`` can matter. A branch is worth about the
        log-probability of its place, which falls along a text; so once that lies DEEP under the
        branches kept, the rest of the text is walked without drawing branches.
        """
        out = Walk([[] for _ in who], [[] for _ in who], logp.copy(), [[] for _ in who])
        unit, at, last = unit.copy(), at.copy(), self.first[who + 1]
        salt = salt_of(turn)
        open_, deep = np.arange(len(who)), []
        while len(open_):
            bar = np.array([max(floor[j], out.branches[j][keep - 1][0] if len(out.branches[j]) >= keep else -np.inf) for j in open_.tolist()])
            low = out.logp[open_] < bar - DEEP
            deep.append(open_[low])
            open_ = open_[~low]
            until = np.minimum(unit + BLOCK, last)
            self.tread(out, open_, who, unit, until, at, value, salt, keep)
            unit[open_] = until[open_]
            open_ = open_[unit[open_] < last[open_]]
            at[open_] = self.lattices.start[self.units[unit[open_]]]
        self.tread(out, np.sort(np.concatenate(deep)) if deep else open_, who, unit, last, at, value, salt, 0)
        return out

    def tread(self, out: Walk, texts: np.ndarray, who: np.ndarray, unit: np.ndarray, until: np.ndarray, at: np.ndarray, value: np.ndarray, salt: np.uint64, keep: int) -> None:
        """Walk ``texts`` (places in ``who``) from their ``unit`` to before ``until``; with ``keep``, draw all branches and keep so many."""
        lat = self.lattices
        many = until[texts] - unit[texts]
        every, owner = ranges(unit[texts], many), np.repeat(texts, many)
        if not len(every):
            return
        begin = lat.start[self.units[every]]
        opening = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        begin[opening] = at[owner[opening]]
        for a in range(0, len(every), WALK):
            inst, own, here = every[a : a + WALK], owner[a : a + WALK], begin[a : a + WALK].copy()
            done, gone = lat.end[self.units[inst]], np.zeros(len(inst))
            shift = self.offset[inst] - lat.start[self.units[inst]]
            within = shift - self.opening[who[own]]  # places in the text, so that values don't depend on the slice
            base = (self.seeds[who[own]] ^ salt) + PLACE * within.astype(np.uint64)
            steps = []
            live = np.flatnonzero(here < done)
            while len(live):
                spot = here.take(live)
                draw = uniform(base.take(live) + PLACE * spot.astype(np.uint64))
                won = lat.first.take(spot)
                less = np.flatnonzero(lat.up_to.take(won) < draw)
                while len(less):
                    next_ = won[less] + 1
                    won[less] = next_
                    less = less[lat.up_to.take(next_) < draw.take(less)]
                before = gone.take(live)
                steps.append((live, spot, won, before))
                gone[live] = before + lat.chance.take(won)
                here[live] = onto = spot + lat.length.take(won)
                live = live[onto < done.take(live)]
            # log-probability before each unit: what its text had, and the units in between
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if keep:
                run = gone.cumsum() - gone
                run += out.logp[own] - np.repeat(run[heads], np.diff(np.append(heads, len(own))))
            out.logp[own[heads]] += np.add.reduceat(gone, heads)
            which, spot, won, up = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 4
            order = np.argsort(which.astype(np.uint16), kind="stable")  # by unit; a unit's steps are in order already
            which, spot, won = which.take(order), spot.take(order), won.take(order)
            place, piece = spot + shift.take(which), lat.piece.take(won)
            cut = np.append(np.searchsorted(which, heads), len(order))
            for t, lo, hi in zip(own[heads].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out.place[t].append(place[lo:hi])
                out.piece[t].append(piece[lo:hi])
            if keep:
                some = np.flatnonzero(lat.count.take(spot) > 1)
                which, spot, won, up = which[some], spot[some], won[some], up.take(order[some])
                draw = uniform(base.take(which) + PLACE * spot.astype(np.uint64) + ASIDE)
                self.set_aside(out, keep, own[which], inst[which], place[some], spot, won, run.take(which) + up, draw, value)

    def set_aside(self, out: Walk, keep: int, text, inst, place, spot, won, up, draw, value) -> None:
        """Keep the best branches of each text; the steps come text by text."""
        if not len(text):
            return
        g = below(value[text], up + self.lattices.others(spot, won), draw)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sizes, mine = np.diff(np.append(heads, len(text))), text[heads].tolist()
        for _ in range(keep):
            top = np.maximum.reduceat(g, heads)
            hit = np.flatnonzero(g == np.repeat(top, sizes))
            hit = hit[np.append(True, text[hit][1:] != text[hit][:-1])]
            hit = hit[np.isfinite(g[hit])]
            for t, *branch, edge in zip(*(x[hit].tolist() for x in (text, g, place, inst, spot, up, won)), strict=True):
                out.branches[t].append((*branch, (edge,)))
            g[hit] = -np.inf
        for t in mine:
            out.branches[t] = sorted(out.branches[t], reverse=True)[:keep]

    def take_up(self, texts: list[int], branches: list[tuple], turn: int) -> list[tuple[int, tuple | None]]:
        """The edge of each branch that inherits its value, and the branch of those still left aside."""
        lat = self.lattices
        places = np.array([b[1] for b in branches], dtype=np.int64) - self.opening[texts]
        at = (self.seeds[texts] ^ salt_of(turn)) + PLACE * places.astype(np.uint64)
        picks, draws = (uniform(at + j).tolist() for j in (TAKEN_UP, LEFT))
        out: list[tuple[int, tuple | None]] = []
        for (value, place, unit, spot, up, taken, *path), pick, draw in zip(branches, picks, draws, strict=True):
            first = int(lat.first[spot])
            odds = {e: exp(x) for e, x in enumerate(lat.chance[first : first + int(lat.count[spot])].tolist(), first) if e not in taken}
            goal, run = pick * sum(odds.values()), 0.0
            for edge, p in odds.items():
                run += p
                if run >= goal:
                    break
            del odds[edge]
            rest = sum(odds.values())
            left = (float(below(value, up + log(rest), draw)), place, unit, spot, up, (*taken, edge), *path) if rest > 0 else None
            out.append((edge, left))
        return out

    def sample(self, k: int) -> tuple[list[list[tuple[np.ndarray, float, float]]], list[float | None]]:
        """Per text up to ``k`` times (pieces, log-probability, value), by falling value; and the next value, if there is one."""
        n = len(self.first) - 1
        who = np.arange(n)
        value = gumbel(self.seeds)
        begin = self.lattices.start[self.units[self.first[:-1]]] if n else np.zeros(0, np.int64)
        found: list[list[tuple]] = [[] for _ in range(n)]
        waiting: list[list[tuple]] = [[] for _ in range(n)]
        walk = self.walk(who, self.first[:-1].copy(), begin, np.zeros(n), value, 0, k, np.full(n, -np.inf))
        prefix = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for turn in range(1, k + 1):
            for j, t in enumerate(who.tolist()):
                place, piece = (np.concatenate([p, *x[j]]) for p, x in zip(prefix[j], (walk.place, walk.piece), strict=True))
                found[t].append((piece, float(walk.logp[j]), float(value[j])))
                waiting[t] += [(*b, place, piece) for b in walk.branches[j]]
            who = np.array([t for t in who.tolist() if waiting[t]], dtype=np.int64)
            if turn == k or not len(who):
                break
            texts, prefix, nexts = who.tolist(), [], []
            best = [waiting[t].pop(max(range(len(waiting[t])), key=lambda i, w=waiting[t]: w[i][0])) for t in texts]
            for t, branch, (edge, left) in zip(texts, best, self.take_up(texts, best, turn), strict=True):
                g, spot, unit, char, logp, _, place, piece = branch
                if left:
                    waiting[t].append(left)
                cut = np.searchsorted(place, spot)
                prefix.append((np.append(place[:cut], spot), np.append(piece[:cut], self.lattices.piece[edge])))
                nexts.append((unit, char + int(self.lattices.length[edge]), logp + float(self.lattices.chance[edge]), g))
            unit, after, logp, value = (np.array(x) for x in zip(*nexts, strict=True))
            floor = np.array([sorted((w[0] for w in waiting[t]), reverse=True)[k - turn - 1] if len(waiting[t]) >= k - turn else -np.inf for t in who.tolist()])
            walk = self.walk(who, unit, after, logp, value, turn, k - turn, floor)
        return found, [max((b[0] for b in w), default=None) for w in waiting]


def with_bytes(pieces: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids, with the byte pieces of each character that has no piece, and where the parts between ``cuts`` lie in them."""
    spots = np.flatnonzero(pieces < 0)
    if not len(spots):
        return pieces, cuts
    values, which = np.unique(pieces[spots], return_inverse=True)
    spelt = [[vocabulary.bytes[b] for b in chr(-1 - p).encode()] for p in values.tolist()]
    sizes = np.array([len(x) for x in spelt])
    count = np.ones(len(pieces), np.int64)
    count[spots] = sizes[which]
    out = np.repeat(pieces, count)
    out[out < 0] = np.array([i for x in spelt for i in x])[ranges((sizes.cumsum() - sizes)[which], sizes[which])]
    return out, np.append(0, count.cumsum())[cuts]


def log_inclusion(logp: float, threshold: float) -> float:
    """Log-probability that a segmentation's own Gumbel value lies over the first value left out."""
    x = logp - threshold
    return float(x if x < -20 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def encode(
    docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 42,
) -> DataFrame:
    """``(doc_id, samples)``: up to ``k`` distinct segmentations of each whole text, sampled without replacement.

    A sample has ``ids``, ``log_prob`` (of the segmentation among all of its text),
    ``value`` (its Gumbel value; samples come by falling value), ``log_inclusion``, the log of
    the probability that it is among the first ``k``, given the next value (with fewer than
    ``k`` + 1 segmentations in all it is 0), and ``exact``, whether the ids decode to the text. The values are functions of ``seed``, the row's id and the
    place in the text, so a row gets the same samples in any batch, order or retry.
    The vocabulary is read on the driver from ``model`` and sent to the tasks (32,000 pieces).

    Defined cases: null and empty texts have one segmentation, the single space piece that
    SentencePiece puts before a text; a null id seeds like 0; rows that repeat id and text get
    the same samples; an empty table gives no rows; a literal U+2581 goes by its bytes, so that every
    text decodes to itself.
    """
    vocabulary = Vocabulary(model, alpha)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found, following = Sampler(texts, [i or 0 for i in batch.column("doc_id").to_pylist()], vocabulary, seed).sample(k)
        pieces, rows, texts_at = [], ([], [], []), [0]
        for each, threshold in zip(found, following, strict=True):
            for piece, logp, value in each:
                pieces.append(piece)
                for column, x in zip(rows, (logp, value, 0.0 if threshold is None else log_inclusion(logp, threshold)), strict=True):
                    column.append(x)
            texts_at.append(len(pieces))
        ids, cuts = with_bytes(np.concatenate([*pieces, np.zeros(0, np.int32)]), np.append(0, np.cumsum([len(x) for x in pieces])).astype(np.int64), vocabulary)
        spelt, sizes = vocabulary.spell(ids)
        ends = np.append(0, sizes.cumsum())[cuts].tolist()
        wanted = (f" {text}".encode() for text, each in zip(texts, found, strict=True) for _ in each)
        exact = [spelt[a:b].tobytes() == text for a, b, text in zip(ends[:-1], ends[1:], wanted, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
        values = [lists, *(pa.array(c, pa.float64()) for c in rows), pa.array(exact, pa.bool_())]
        samples = pa.ListArray.from_arrays(pa.array(texts_at, pa.int32()), pa.StructArray.from_arrays(values, ["ids", "log_prob", "value", "log_inclusion", "exact"]))
        yield {"doc_id": batch.column("doc_id"), "samples": samples}

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, samples array<struct<ids:array<int>,log_prob:double,value:double,log_inclusion:double,exact:boolean>>"
    return in_batches(rows, work, schema, max_bytes=1 << 18)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of the piece ids in ``ids_col``; null for null ids or a null or unknown id among them."""
    vocabulary = Vocabulary(model)
    size, others = len(vocabulary.pieces), [c for c in rows.columns if c != out_col]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [
            None if ids is None or any(i is None or not 0 <= i < size for i in ids) else vocabulary.decode(ids) for ids in batch.column(ids_col).to_pylist()
        ]
        yield {c: batch.column(c) for c in others} | {out_col: texts}

    schema = rows.drop(out_col).withColumn(out_col, F.lit(None).cast("string")).schema
    return in_batches(rows, work, schema, max_bytes=4 << 20)
