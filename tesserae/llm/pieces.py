"""SentencePiece encoding and decoding, with segmentations sampled without replacement by Gumbel top-k.

A text's segmentations are the paths of a lattice: at each character every piece that matches there is an arc, and a
character without a piece is an arc of byte pieces. A path's probability is in proportion to the product of its pieces'
weights. The vocabulary is a BPE one and has merge ranks for scores, so a piece weighs 1 / (OFFSET + rank), a Zipf prior,
and TEMPERATURE flattens it; models with log probabilities use those.

Sampling is a best-first (A*) search from the lattice's root. A node of the agenda is a set of paths: a common prefix and, at
the state after it, the arcs not taken yet. Its value is the largest Gumbel-perturbed log probability of its paths, which
is known without listing them: Gumbel noise at the log of the set's mass, truncated at the value of the node it was split
from. The best node gives the next sample: the path drawn from its set by the lattice's backward masses; the alternatives
left at each state of that path are new nodes. The k paths found first are the k largest of all perturbed paths, so they
are a sample without replacement. A path's inclusion score is log P(value > kappa), kappa being the next value found.

Pieces never join letters to other characters, nor go on over a space, so the lattice is cut into such units; each unit's
states are built once and kept by workers, up to MOST_STATES. All random numbers are hashes of the row's key, the sample's
number and the place, so results don't depend on batches or tasks.

Defined results: null and empty texts have one segmentation, of no pieces, with log probability 0; a text with fewer than
k segmentations gives them all, with inclusion score 0; rows with equal keys and texts get equal samples; extra columns
are dropped by `sample`; U+2581 counts as a space, as in the library.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

SPACE = "▁"
OFFSET = 20.0
TEMPERATURE = 1.0
#: States of units that a worker keeps, with some three arcs each, at 16 bytes an arc, and the share of them that stays when there are more.
MOST_STATES = 1_500_000
KEPT = 0.3
#: Units whose states are built at once; that takes some 4 KB for each.
LEARN = 1_000
#: Characters from which a unit's states are built one by one.
LONG_UNIT = 64
#: Characters of a batch of texts that are sampled together: fewer take less memory and more time.
BATCH_CHARS = 1 << 20
#: Pieces of a path from its start whose alternatives are looked at first; more where these don't decide.
WINDOW = 512
#: No Gumbel number from a 53-bit uniform one is larger.
MOST_NOISE = 37.0

_WORD = re.compile(rf"({SPACE}*)([^{SPACE}]*)")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


np.seterr(over="ignore", divide="ignore")  # hashes wrap around; the log of no mass is -inf


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: uniform hashes of uint64 numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((mixed(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u):
    return -np.log(-np.log(u))


def cut_at(top, g):
    """Gumbel numbers g conditioned on none exceeding `top`, made from unconditioned ones."""
    return -np.logaddexp(-top, -g)


class Lattice:
    """States of units. A state is a character of a unit; its arcs stand together, likelier ones first."""

    def __init__(self, model: str, offset: float = OFFSET, temperature: float = TEMPERATURE, most_states: int = MOST_STATES):
        import sentencepiece

        self.most_states = most_states
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        scores = [sp.get_score(i) for i in range(n)]
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id: dict[int, int] = {}
        self.weights: dict[str, tuple[int, float]] = {}
        ranked = min(x for x in scores if x > -1e8) < -100  # merge ranks, not log probabilities
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                # Runs of spaces have no rank of their own in a BPE model; the place among the ids stands for it.
                score = scores[i] if scores[i] > -1e8 else -float(i)
                self.weights[piece] = (i, (1.0 / (offset - score) if ranked else math.exp(score)) ** (1 / temperature))
        total = sum(w for _, w in self.weights.values())
        self.weights = {piece: (i, w / total) for piece, (i, w) in self.weights.items()}
        self.byte_weight = min(w for _, w in self.weights.values()) / 4
        self.longest = max(map(len, self.weights))
        for piece in self.weights:
            rest = piece.lstrip(SPACE)
            if SPACE in rest or len(set(map(str.isalpha, rest))) > 1:
                raise ValueError("a piece goes over the units' ends: " + piece)
        self.scale = 8.0  # a factor for each character, which keeps the masses of a unit near 1 and all ratios as they are
        self._tables()
        self.clear()

    def _tables(self) -> None:
        """Pieces and their prefixes by hash, for lookups of many substrings at a time."""
        entries: dict[int, tuple[int, float]] = {}
        prefixes: set[int] = set()
        for piece, (i, w) in self.weights.items():
            h = 0
            for c in piece:
                h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.add(h)
            entries[h] = (i, w)
        if len(entries) != len(self.weights):
            raise ValueError("two pieces have the same hash")
        size = 1 << 20
        self.slot_hash = np.zeros(size, np.uint64)
        self.slot_id = np.full(size, -1, np.int32)
        self.weight_of = np.zeros(len(self.bytes_of))
        self.probes = 1
        for h in prefixes:
            at = (h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44
            k = 1
            while self.slot_hash[at]:
                at = (at + 1) % size
                k += 1
            self.probes = max(self.probes, k)
            self.slot_hash[at] = h
            if h in entries:
                i, w = entries[h]
                self.slot_id[at], self.weight_of[i] = i, w

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}  # what stands between two spaces, to the first states of its units
        self.states = self.arcs = 0
        if not hasattr(self, "first"):  # they grow as they fill
            self.first, self.count = (np.empty(1 << 18, np.int32) for _ in range(2))
            self.cum, self.next, self.token, self.log = (np.empty(3 << 18, t) for t in (np.float32, np.int32, np.int32, np.float32))

    def shrink(self, states: int) -> None:
        """Forget all but the units that were met first, of about so many states: those are the frequent ones."""
        bases = list(self.units.values())  # ascending
        n = bisect.bisect_left(bases, states)
        if n < len(bases):
            self.states, self.arcs = bases[n], int(self.first[bases[n]])
            self.units = dict(itertools.islice(self.units.items(), n))
            self.words = {word: own for word, own in self.words.items() if max(own) < self.states}

    def _room(self, names: tuple[str, ...], used: int, more: int) -> None:
        for name in names:
            held = getattr(self, name)
            if used + more > len(held):
                new = np.empty(max(3 * len(held) // 2, used + more), held.dtype)
                new[:used] = held[:used]
                setattr(self, name, new)

    def learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= LONG_UNIT]
        for k in range(0, len(short), LEARN):
            self._many(short[k : k + LEARN])
        for u in units:
            if len(u) > LONG_UNIT:
                self._long(u)

    def _add(self, bases: dict[str, int], states: int, state: np.ndarray, to: np.ndarray, token: np.ndarray, mass: np.ndarray) -> None:
        """Append arcs (state and `to` count from 0; to = -1 ends the unit; `mass` is weight times backward mass)."""
        share = mass / np.bincount(state, mass, states)[state]
        order = np.argsort(state + 0.999 * (1 - share))
        state, to, token, q = state[order], to[order], token[order], share[order]
        count = np.bincount(state, minlength=states)
        first = np.cumsum(count) - count
        run = np.cumsum(q)
        cum = run - (run[first] - q[first])[state]
        cum[first + count - 1] = 2.0
        log = np.log(q)
        log[first[count == 1]] = 0.0
        n, m = len(state), states
        self._room(("first", "count"), self.states, m)
        self._room(("cum", "next", "token", "log"), self.arcs, n)
        self.first[self.states : self.states + m] = first + self.arcs
        self.count[self.states : self.states + m] = count
        self.cum[self.arcs : self.arcs + n] = cum
        self.next[self.arcs : self.arcs + n] = np.where(to < 0, -1, to + self.states)
        self.token[self.arcs : self.arcs + n] = token
        self.log[self.arcs : self.arcs + n] = log
        for u, b in bases.items():
            self.units[u] = b + self.states
        self.states += m
        self.arcs += n

    def _many(self, units: list[str]) -> None:
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        n = len(codes)
        at = np.arange(n)
        h = np.zeros(n, np.uint64)
        parts = []
        single = np.zeros(n, bool)
        for size in range(1, self.longest + 1):
            h = h * np.uint64(0x100000001B3) + codes[at + size - 1] + np.uint64(1)
            slot = ((h * _GOLDEN) >> np.uint64(44)).astype(np.int64)
            hit = self.slot_hash[slot] == h
            for _ in range(self.probes - 1):
                if hit.all():
                    break
                slot = np.where(hit, slot, (slot + 1) % len(self.slot_hash))
                hit = self.slot_hash[slot] == h
            at, h, slot = at[hit], h[hit], slot[hit]
            whole = self.slot_id[slot] >= 0
            if size == 1:
                single[at[whole]] = True
            piece = self.slot_id[slot[whole]]
            parts.append((at[whole], np.full(len(piece), size), piece, self.weight_of[piece]))
            go = at + size < ends[at]
            at, h = at[go], h[go]
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        if len(lone):
            c = codes[lone].astype(np.int64)
            width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            byte = np.array([self.byte_id.get(i, 0) for i in range(256)])
            parts.append((lone, np.ones(len(lone), int), np.where(c < 128, byte[np.minimum(c, 127)], -c - 1), self.byte_weight**width))
        start, size, token, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        weight = weight * self.scale**size
        left = ends - np.arange(n)  # characters to the unit's end
        order = np.argsort(left[start])
        start, size, token, weight = start[order], size[order], token[order], weight[order]
        mass = np.empty(len(start))
        backward = np.zeros(n)
        edges = np.searchsorted(left[start], np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(edges, edges[1:], strict=False):
            s = start[a:b]
            to = s + size[a:b]
            mass[a:b] = weight[a:b] * np.where(to == ends[s], 1.0, backward[np.minimum(to, n - 1)])
            backward += np.bincount(s, mass[a:b], n) if b - a > n // 64 else 0
            if b - a <= n // 64:
                np.add.at(backward, s, mass[a:b])
        to = start + size
        bases = dict(zip(units, (np.cumsum(sizes) - sizes).tolist(), strict=True))
        self._add(bases, n, start, np.where(to == ends[start], -1, to), token, mass)

    def _long(self, unit: str) -> None:
        n = len(unit)
        backward = [1.0] * (n + 1)
        state, to, token, mass = [], [], [], []
        for at in range(n - 1, -1, -1):
            total = 0.0
            found = False
            for size in range(1, min(self.longest, n - at) + 1):
                hit = self.weights.get(unit[at : at + size])
                if hit:
                    found = found or size == 1
                    m = hit[1] * self.scale**size * backward[at + size]
                    state.append(at), to.append(at + size), token.append(hit[0]), mass.append(m)
                    total += m
            if not found:
                c = ord(unit[at])
                m = self.byte_weight ** len(unit[at].encode("utf-8", "surrogatepass")) * self.scale * backward[at + 1]
                state.append(at), to.append(at + 1), token.append(self.byte_id[c] if c < 128 else -c - 1), mass.append(m)
                total += m
            backward[at] = total
            if not 1e-100 < total < 1e100:  # only ratios matter
                for k in range(at, min(n, at + self.longest) + 1):
                    backward[k] /= total
        ends = np.array(to)
        self._add({unit: 0}, n, np.array(state), np.where(ends == n, -1, ends), np.array(token), np.array(mass))

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """The first state of each unit of each text; unknown units are learnt."""
        if self.states > self.most_states:
            self.shrink(int(KEPT * self.most_states))
        # Where no two spaces meet, what stands between spaces is looked up whole, once for all its places.
        plain = [k for k, t in enumerate(texts) if t and "  " not in t and SPACE not in t and t[-1] != " "]
        try:
            cut = pc.split_pattern(pa.array([texts[k] for k in plain], pa.string()), " ")
        except UnicodeEncodeError:  # halves of characters
            plain, cut = [], pa.array([], pa.list_(pa.string()))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slow = {k: units_of(texts[k]) for k in sorted({*range(len(texts))}.difference(plain))}
        self._enter({*itertools.filterfalse(self.words.__contains__, words)}, itertools.chain.from_iterable(slow.values()))
        out = [np.fromiter(map(self.units.__getitem__, slow[k]), np.int32) if k in slow else None for k in range(len(texts))]
        own = [*map(self.words.__getitem__, words)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        table = np.fromiter(itertools.chain.from_iterable(own), np.int32)
        which = coded.indices.to_numpy()
        size = sizes[which]
        stop = np.cumsum(size)
        found = table[np.repeat((np.cumsum(sizes) - sizes)[which] - (stop - size), size) + np.arange(size.sum())]
        edges = np.append(0, stop)[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))).astype(np.int64)].tolist()
        for k, lo, hi in zip(plain, edges[:-1], edges[1:], strict=True):
            out[k] = found[lo:hi]
        return out

    def _enter(self, words: set[str], units: Iterable[str] = ()) -> None:
        """Make words and further units known."""
        letters = [w for w in words if w.isalpha()]
        whole = [SPACE + w for w in letters]
        # Most others are letters and one more character.
        parts = {w: [SPACE + w[:-1], w[-1]] if w[:-1].isalpha() else cut_word(SPACE, w) for w in words.difference(letters)}
        unknown = set(itertools.chain(whole, itertools.chain.from_iterable(parts.values()), units)).difference(self.units)
        if unknown:
            self.learn(sorted(unknown))
        of = self.units.__getitem__
        self.words.update(zip(letters, zip(map(of, whole), strict=True), strict=True))
        for word, own in parts.items():
            self.words[word] = tuple(map(of, own))

    def walk(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path to the end of each unit from `state` (-1: nothing left); returns arcs in order, and how many each."""
        live = np.flatnonzero(state >= 0)
        at = state[live]
        steps = np.zeros(len(state), np.int64)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(live):
            u = uniform(key[live] + np.uint64(turn) * _GOLDEN)
            arc = self.first[at]
            low = np.flatnonzero(self.cum[arc] < u)
            while len(low):
                arc[low] += 1
                low = low[self.cum[arc[low]] < u[low]]
            seen.append((live, arc))
            steps[live] += 1
            at = self.next[arc]
            more = at >= 0
            live, at = live[more], at[more]
            turn += 1
        out = np.empty(int(steps.sum()), np.int32)
        base = np.cumsum(steps) - steps
        for turn, (who, arc) in enumerate(seen):
            out[base[who] + turn] = arc
        return out, steps

    def plain(self, tokens: np.ndarray) -> np.ndarray:
        """Ids, with characters that have no piece (negative) written as byte pieces."""
        if len(tokens) and tokens.min() < 0:
            out: list[int] = []
            for t in tokens.tolist():
                out += [t] if t >= 0 else [self.byte_id[b] for b in chr(-t - 1).encode("utf-8", "surrogatepass")]
            return np.array(out, "<u4")
        return tokens.astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def units_of(text: str) -> list[str]:
    """The units of a text: runs of letters, or of other characters, with the spaces before them."""
    return [u for spaces, word in _WORD.findall(SPACE + text.replace(" ", SPACE)) for u in cut_word(spaces, word)] if text else []


def cut_word(spaces: str, word: str) -> list[str]:
    parts = ["".join(g) for _, g in itertools.groupby(word, str.isalpha)]
    if spaces:
        parts[:1] = [spaces + parts[0] if parts else spaces]
    return parts


class Sample:
    """One segmentation: ids, log probability, perturbed log probability, log inclusion."""

    __slots__ = ("ids", "log", "value", "inclusion")

    def __init__(self, ids: np.ndarray, log: float, value: float):
        self.ids, self.log, self.value, self.inclusion = ids, log, value, 0.0


def sample_texts(lattice: Lattice, texts: list[str], keys: list[int], k: int) -> list[list[Sample]]:
    """The k samples of each text, largest perturbed value first."""
    starts = lattice.starts(texts)
    seeds = mixed(np.array(keys, np.int64).astype(np.uint64) + _GOLDEN)
    n = len(texts)
    out: list[list[Sample]] = [[] for _ in range(n)]
    # An agenda of (-value, number, path, place, excluded arcs) for each text;
    agenda: list[list] = [[] for _ in range(n)]
    paths: list[list[np.ndarray]] = [[] for _ in range(n)]
    first = gumbel(uniform(seeds + np.uint64(0xA5A5A5A5)))
    for d in range(n):
        agenda[d].append((-float(first[d]), 0, -1, 0, ()))
    number = [1] * n
    for turn in range(k):
        jobs = []  # text, value, arcs of the prefix, state to go on from, unit to go on after
        for d in range(n):
            if not agenda[d]:
                continue
            value, _, parent, place, out_arcs = heapq.heappop(agenda[d])
            if parent < 0:
                jobs.append((d, -value, np.zeros(0, np.int32), -1, 0, ()))
                continue
            arcs = paths[d][parent]
            state = _state_of(lattice, starts[d], arcs, place)
            lo = int(lattice.first[state])
            here = np.arange(lo, lo + int(lattice.count[state]))
            here = here[~np.isin(here, out_arcs)]
            p = np.exp(lattice.log[here].astype(np.float64))
            u = float(uniform(seeds[d : d + 1] + np.uint64(turn * 1_000_003 + 17) * _GOLDEN)[0])
            arc = int(here[min(len(here) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), u)))])
            prefix = np.append(arcs[:place], np.int32(arc))
            done = int((lattice.next[arcs[:place]] < 0).sum())  # units before the one that is branched in
            jobs.append((d, -value, prefix, int(lattice.next[arc]), done + 1, (*out_arcs, arc)))
        if not jobs:
            break
        states = np.concatenate([np.append(np.int32(go_on), starts[d][unit:]) for d, _, _, go_on, unit, _ in jobs]) if jobs else np.zeros(0, np.int32)
        sizes = [1 + len(starts[d]) - unit for d, _, _, _, unit, _ in jobs]
        who = np.repeat(np.array([d for d, *_ in jobs]), sizes)
        place = np.concatenate([np.arange(unit, unit + s) for (_, _, _, _, unit, _), s in zip(jobs, sizes, strict=True)])
        key = mixed(seeds[who] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(turn + 1) * np.uint64(0x2545F4914F6CDD1D))
        drawn, steps = lattice.walk(states, key)
        edges = np.append(0, np.cumsum(np.add.reduceat(steps, np.cumsum([0, *sizes[:-1]])))).tolist()
        logs = np.append(lattice.log[drawn].astype(np.float64), 0.0)
        tokens = lattice.token[drawn]
        head = np.zeros((len(jobs), WINDOW), np.int32)  # the first arcs from the branching place on
        there = np.zeros((len(jobs), WINDOW), bool)
        base = np.zeros(len(jobs))
        for j, (d, value, prefix, _, _, _) in enumerate(jobs):
            a, b = edges[j], edges[j + 1]
            if len(prefix):
                arcs, ids = np.concatenate([prefix, drawn[a:b]]), np.concatenate([lattice.token[prefix], tokens[a:b]])
                log = lattice.log[prefix].astype(np.float64)
                base[j] = log[:-1].sum()
                total = log.sum() + logs[a:b].sum()
            else:
                arcs, ids, total = drawn[a:b], tokens[a:b], logs[a:b].sum()
            out[d].append(Sample(lattice.plain(ids), float(total), value))
            paths[d].append(arcs)
            window = arcs[max(0, len(prefix) - 1) :][:WINDOW]
            head[j, : len(window)] = window
            there[j, : len(window)] = True
        _branch(lattice, agenda, number, jobs, paths, head, there, base, seeds, turn, k + 1)
    for d in range(n):
        kappa = -agenda[d][0][0] if agenda[d] else -math.inf
        for s in out[d]:
            s.inclusion = _log_inclusion(s.log - kappa)
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x < -30:
        return x
    return 0.0 if x > 700 else math.log(-math.expm1(-math.exp(x)))


def _state_of(lattice: Lattice, starts: np.ndarray, arcs: np.ndarray, place: int) -> int:
    """The state before arc number `place` of a path."""
    if place and lattice.next[arcs[place - 1]] >= 0:
        return int(lattice.next[arcs[place - 1]])
    return int(starts[int((lattice.next[arcs[:place]] < 0).sum())])


def _branch(lattice, agenda, number, jobs, paths, head, there, base, seeds, turn, wanted) -> None:
    """Put the best `wanted` sets of alternatives to each new path, from the place where it branched on, on its text's agenda.

    `head` holds the paths' first WINDOW arcs from there on, for all texts at once; a path whose later alternatives could
    still be better, by the largest noise there is, is looked at further by itself.
    """
    texts = np.array([d for d, *_ in jobs])
    values = np.array([v for _, v, *_ in jobs])
    fixed = np.array([max(0, len(p) - 1) for _, _, p, *_ in jobs])

    def noisy(log, before, places, rows, taken):
        off = np.where(log < 0, np.log(-np.expm1(log)), -np.inf)
        for j, out_arcs in taken:  # at the branching state, all arcs taken so far are out
            left = 1 - sum(math.exp(float(lattice.log[a])) for a in out_arcs)
            state = np.searchsorted(lattice.first[: lattice.states], np.int32(out_arcs[0]), side="right") - 1
            off[j, 0] = math.log(left) if len(out_arcs) < int(lattice.count[state]) and left > 1e-15 else -np.inf
        keys = seeds[texts[rows]][:, None] + np.uint64(turn + 1) * np.uint64(0x9FB21C651E98DF25) + places.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        return cut_at(values[rows][:, None], before + off + gumbel(uniform(keys)))

    log = np.where(there, lattice.log[head].astype(np.float64) if lattice.arcs else 0.0, 0.0)
    after = base[:, None] + np.cumsum(log, axis=1)
    found = noisy(log, after - log, fixed[:, None] + np.arange(head.shape[1]), np.arange(len(jobs)), [(j, x[5]) for j, x in enumerate(jobs) if x[5]])
    order = np.argsort(-found, axis=1)[:, :wanted]
    best = np.take_along_axis(found, order, axis=1)
    for j, (d, _, _, _, _, taken) in enumerate(jobs):
        arcs = paths[d][-1]
        at, at_value = order[j].tolist(), best[j].tolist()
        start = int(fixed[j])
        if len(arcs) - start > WINDOW and after[j, -1] + MOST_NOISE >= at_value[-1]:
            log_j = lattice.log[arcs[start:]].astype(np.float64)[None]
            before = base[j] + np.cumsum(log_j, axis=1) - log_j
            whole = noisy(log_j, before, (start + np.arange(log_j.shape[1]))[None], np.array([j]), [(0, taken)] if taken else [])[0]
            at = np.argsort(-whole)[:wanted].tolist()
            at_value = whole[at].tolist()
        for k, v in zip(at, at_value, strict=True):
            if v > -math.inf:
                heapq.heappush(agenda[d], (-v, number[d], len(paths[d]) - 1, start + k, tuple(taken) if k == 0 and taken else (int(arcs[start + k]),)))
                number[d] += 1


def lattice_of(model: str, offset: float = OFFSET, temperature: float = TEMPERATURE, most_states: int = MOST_STATES) -> Lattice:
    """The worker's lattice, with the units that earlier tasks met."""
    key = (model, offset, temperature, most_states)
    own = common.held(__name__)
    if key not in own:
        own.clear()
        own[key] = Lattice(model, offset, temperature, most_states)
    return own[key]


SAMPLES = T.StructType(
    [
        T.StructField("sample", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("log_prob", T.DoubleType()),
        T.StructField("perturbed", T.DoubleType()),
        T.StructField("log_inclusion", T.DoubleType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def sample(docs: DataFrame, model: str, *, k: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True, offset: float = OFFSET, temperature: float = TEMPERATURE, most_states: int = MOST_STATES, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """A row for each of the k sampled segmentations of each text, seeded by the row's key.

    A worker keeps `most_states` states of units, and those of one batch of `batch_chars` more: both take memory and save time. ids are little-endian unsigned 32-bit numbers (null unless `with_ids`); round_trip tells whether decoding them gives the text.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField(key, T.LongType()), *SAMPLES.fields])
    arrow = pa.schema([(key, pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, offset, temperature, most_states)
        for batch in common.sliced(batches, "_text", batch_chars):
            texts = [v or "" for v in batch.column("_text").to_pylist()]
            names = batch.column(key).to_pylist()
            found = []
            for name, value, samples in zip(names, texts, sample_texts(lattice, texts, [x or 0 for x in names], k), strict=True):
                plain = value.replace(SPACE, " ")
                for number, s in enumerate(samples):
                    data = s.ids.tobytes()
                    found.append((name, number, data if with_ids else None, len(s.ids), zlib.crc32(data), s.log, s.value, s.inclusion, lattice.decode(s.ids) == plain))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
            common.give_back()

    return common.mapped(rows, run, schema, __name__)


def encode(docs: DataFrame, model: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """The library's own encoding of each text, as an array of ids. One narrow pass."""
    docs = docs.drop(into) if into in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = lattice_of(model).sp
        for batch in batches:
            ids = sp.encode([v or "" for v in batch.column(text).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, into])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]), __name__)


def decode(docs: DataFrame, model: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """The text of an array of ids, in place of any column `into`. One narrow pass; null ids give an empty text."""
    docs = docs.drop(into) if into in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = lattice_of(model).sp
        for batch in batches:
            texts = [sp.decode(v) if v else "" for v in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]), __name__)
