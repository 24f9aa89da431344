"""Operator 1: SentencePiece encoding, sampling without replacement, decoding.

Encoding gives the ids of the SentencePiece library. No piece has a space after
another character, and none has a line feed, so a text's ids are those of its
units in turn: a run of spaces and what follows, or a line feed and what
follows. Each distinct unit of a chunk is encoded once, and units of earlier
chunks of a task stay known, with their lattices, up to a number of states.

Sampling draws distinct segmentations of a whole text from the lattice of all
its segmentations into pieces. A piece weighs as a unigram whose probability
falls with its rank (Zipf), as the BPE model has no probabilities of its own.
Gumbel top-k without replacement is a perturbed A* search: every lattice node
is bounded by the largest Gumbel-perturbed log-probability below it, drawn top
down given its parent's, and nodes are taken best first. The best leaf below a
node follows the lattice's own conditional probabilities, so it is drawn for
all texts of a chunk at once; its siblings get truncated Gumbels. After k
leaves the best open bound is the threshold kappa, and a segmentation is in the
sample with probability 1 - exp(-exp(log_prob - kappa)), its inclusion score.
All random numbers are hashes of the row key, leaf, and place.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import table

DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, CHUNK_BYTES = 2, 1 << 19
#: Of the units that a task keeps; a state and its arcs take about 60 bytes.
KEPT_STATES = 1 << 19
#: Siblings whose log-probability is below this can't be reached: a Gumbel of such height has a chance of about e**-40.
DEEPEST = -40.0
SPACE = "▁"
#: Of Zipf's law p = 1 / ((rank + shift) * total).
ZIPF_SHIFT, ZIPF_TOTAL = 2.7, 10.4
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = tk.mix(np.array([97], np.uint64))

_models: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, dtype=np.int32)
        normal = []
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                normal.append(i)
        self.bytes_of = [b""] * n
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        for i in normal:
            self.bytes_of[i] = self.pieces[i].replace(SPACE, " ").encode()
        if any("\n" in self.pieces[i] for i in normal):
            raise ValueError("a model whose pieces hold line feeds")
        self.longest = max(len(self.pieces[i]) for i in normal)
        rank = np.arange(len(normal))
        self.byte_weight = -float(np.log((len(normal) + ZIPF_SHIFT) * ZIPF_TOTAL))
        keys = np.array([self._key(self.pieces[i]) for i in normal], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, dtype=np.int32)[order]
        self.weights = -np.log((rank + ZIPF_SHIFT) * ZIPF_TOTAL).astype(np.float32)[order]
        # By hash: 1 if a string is a piece, 2 if a longer piece begins with it, 3 if both; above these bits the place of the first such key.
        self.kind = np.zeros(1 << 22, dtype=np.int32)
        slot = (self.keys >> np.uint64(42)).astype(np.int64)
        self.kind[slot[::-1]] = np.arange(len(slot))[::-1] * 4 + 1
        self.crowd = int(np.bincount(np.unique(slot, return_inverse=True)[1]).max())
        for begin in {self.pieces[i][:k] for i in normal for k in range(1, len(self.pieces[i]))}:
            self.kind[self._key(begin) >> 42] |= 2
        self.lone_space = [self.library.piece_to_id(SPACE)]
        self.byte_strings = pa.array(self.bytes_of, pa.large_binary())
        self.known: dict[bool, Units] = {}

    @staticmethod
    def _key(piece: str) -> int:
        """The hash that Lattice makes of a string, in whole numbers."""
        h, all_bits = 0, (1 << 64) - 1
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & all_bits
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & all_bits
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & all_bits
        return h ^ (h >> 31)

    def units(self, text: str) -> list[str]:
        """The units of a text, those that begin with a space without it. A
        literal U+2581 is kept apart by a noncharacter that the text lacks."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, self.stand_in(text))
        return [u if u[0] == "\n" else u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]

    def all_units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units of texts, the unit of each place, and where texts
        begin. Texts without adjoining spaces are split by Arrow."""
        apart = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        plain = pc.invert(pc.or_(pc.match_substring(apart, "  "), pc.or_(pc.match_substring(apart, SPACE), pc.or_(pc.starts_with(apart, " "), pc.or_(pc.ends_with(apart, " "), pc.equal(apart, "")))))).to_pylist()
        lists = pc.split_pattern(pc.if_else(pa.array(plain), apart, ""), " ")
        split, counts = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        units, occ = split.dictionary.to_numpy(zero_copy_only=False).tolist(), split.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not all(plain):
            place = dict(zip(units, range(len(units)), strict=True))
            begins, parts = np.concatenate(([0], np.cumsum(counts))), []
            done = 0
            for d in [d for d, p in enumerate(plain) if not p]:
                own = np.array([place.setdefault(u, len(place)) for u in self.units(texts[d])], dtype=np.int64)
                parts += [occ[done : begins[d]], own]
                done, counts[d] = begins[d + 1], len(own)
            occ, units = np.concatenate([*parts, occ[done:]]), list(place)
        return units, occ, np.concatenate(([0], np.cumsum(counts)))

    def encode(self, text: str) -> np.ndarray:
        return segment_chunk(self, [text], np.zeros(1, np.uint64), 0)[0][0][0]

    @staticmethod
    def stand_in(text: str) -> str:
        """A character that the text lacks: a noncharacter, else one of private use."""
        return next(c for c in map(chr, chain(range(0xFDD0, 0xFDF0), range(0xE000, 0xF900))) if c not in text)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, end to end, and where each begins."""
        lists = self.library.encode([u if SPACE not in u else u.replace(SPACE, " ") for u in units], num_threads=1)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        # The library puts a space before a line feed too, and none before nothing.
        lines = np.array([i for i, u in enumerate(units) if u[:1] == "\n"], dtype=np.int64)
        empty = [i for i, u in enumerate(units) if not u]
        ids = np.insert(ids, begins[empty], self.lone_space * len(empty)) if empty else ids
        sizes[empty] = 1
        ids = np.delete(ids, (np.cumsum(sizes) - sizes)[lines])
        sizes[lines] -= 1
        return ids, np.concatenate(([0], np.cumsum(sizes)))

    def repaired(self, ids: np.ndarray, text: str) -> np.ndarray:
        """With the bytes of U+2581 in place of its stand-in's."""
        stand_in = self.byte[list(self.stand_in(text).encode())]
        at = np.flatnonzero((ids[:-2] == stand_in[0]) & (ids[1:-1] == stand_in[1]) & (ids[2:] == stand_in[2])) if len(ids) > 2 else []
        ids = ids.copy()
        for i, b in enumerate(self.byte[list(SPACE.encode())]):
            ids[np.asarray(at, dtype=np.int64) + i] = b
        return ids

    def with_bytes(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """``ids`` with the byte pieces of a character in place of each -1."""
        bare = np.flatnonzero(ids < 0)
        codes = [chr(c).encode("utf-8", "surrogatepass") for c in chars[bare].tolist()]
        width = np.ones(len(ids), dtype=np.int64)
        width[bare] = list(map(len, codes))
        out, is_byte = np.repeat(ids, width), np.repeat(ids < 0, width)
        out[is_byte] = self.byte[np.frombuffer(b"".join(codes), np.uint8)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a text from its ids, without the space put before it."""
        return self.decode_all([ids])[0]

    def decode_all(self, texts: list[np.ndarray]) -> list[bytes]:
        """``decode_bytes`` of each of many texts."""
        found = self.byte_strings.take(pa.array(np.concatenate(texts, dtype=np.int32)))
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.concatenate(([0], np.cumsum(list(map(len, texts)))))].tolist()
        whole = data.to_pybytes() if data is not None else b""
        return [whole[lo + 1 : hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]

    def kept(self, sampled: bool) -> Units:
        """The units known so far, with their lattices if ``sampled``."""
        if sampled not in self.known:
            self.known[sampled] = Units(self, sampled)
        return self.known[sampled]


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of each span, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


class Column:
    """An array that grows at its end."""

    def __init__(self, dtype, values=()):
        self.room = np.array(values, dtype=dtype)
        self.n = len(self.room)

    def add(self, values) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(2 * (self.n + len(values)), dtype=self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def keep(self, places: np.ndarray) -> None:
        self.room = self.room[places]
        self.n = len(self.room)


class Units:
    """Distinct units with their encodings, end to end, and lattices."""

    def __init__(self, model: PieceModel, sampled: bool):
        self.model, self.place = model, {}
        self.ids, self.sizes, self.met = Column(np.int32), Column(np.int64), Column(np.int64)
        self.begins = Column(np.int64)
        self.lattice = Lattice(model) if sampled else None

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each of a chunk's distinct units, new ones taken in.
        Numbers given before for other chunks are void then."""
        if (len(self.lattice.degree.all) if self.lattice else self.ids.n) > KEPT_STATES:
            self.thin()
        found = np.fromiter(map(self.place.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(found < 0)
        fresh = [units[i] for i in missing.tolist()]
        if fresh:
            found[missing] = np.arange(len(self.place), len(self.place) + len(fresh))
            self.place.update(zip(fresh, found[missing].tolist(), strict=True))
            flat, begins = self.model.encode_units(fresh)
            self.begins.add(begins[:-1] + self.ids.n)
            self.ids.add(flat)
            self.sizes.add(np.diff(begins))
            self.met.add(np.zeros(len(fresh), np.int64))
            if self.lattice:
                self.lattice.add(fresh)
        self.met.all[found] += 1
        return found

    def thin(self) -> None:
        """Keeps the units that two chunks had since the last time, or more
        chunks than two, so that these take at most half of the room."""
        states, met, times = self.lattice.states.all if self.lattice else self.sizes.all, self.met.all, 2
        keep = np.flatnonzero(met >= times)
        while states[keep].sum() > KEPT_STATES // 2:
            times += 1
            keep = keep[met[keep] >= times]
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.ids.keep(spans(self.begins.all[keep], self.sizes.all[keep]))
        self.sizes.keep(keep)
        self.begins = Column(np.int64, np.cumsum(self.sizes.all) - self.sizes.all)
        self.met = Column(np.int64, np.zeros(len(keep)))
        if self.lattice:
            self.lattice.keep(keep)


class Lattice:
    """Lattices of distinct units, side by side. A state is a place in a unit;
    its arcs, one for each piece that begins there, lie end to end by length.
    A unit's end has none."""

    def __init__(self, model: PieceModel):
        self.model = model
        #: Of units: first state and number of states.
        self.start, self.states = Column(np.int64), Column(np.int64)
        #: Of states: first arc, number of arcs, the likeliest one among them, probability of all others, character.
        self.first, self.degree, self.top, self.others, self.char = Column(np.int64), Column(np.int16), Column(np.int16), Column(np.float32), Column(np.uint32)
        #: Of arcs: length, piece, log-probability, and probability of it and those before it. A character without a piece of its own is -1 and goes as bytes.
        self.size, self.piece, self.log, self.sums = Column(np.int16), Column(np.int16 if len(model.pieces) < 1 << 15 else np.int32), Column(np.float32), Column(np.float32)

    def keep(self, units: np.ndarray) -> None:
        states = spans(self.start.all[units], self.states.all[units])
        arcs = spans(self.first.all[states], self.degree.all[states].astype(np.int64))
        self.states.keep(units)
        self.start = Column(np.int64, np.cumsum(self.states.all) - self.states.all)
        for column in (self.degree, self.top, self.others, self.char):
            column.keep(states)
        self.first = Column(np.int64, np.cumsum(self.degree.all, dtype=np.int64) - self.degree.all)
        for column in (self.size, self.piece, self.log, self.sums):
            column.keep(arcs)

    def add(self, units: list[str]) -> None:
        model = self.model
        units = [u if u[:1] == "\n" else SPACE + u for u in units]
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        inner = np.delete(np.arange(n, dtype=np.int32), ends)
        char = np.zeros(n, dtype=np.uint64)
        char[inner] = codes
        distance = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.int32)
        hits, degree = [], np.zeros(n, dtype=np.int16)
        at, room = inner, distance[inner]
        h = char[at] + np.uint64(1)
        for size in range(1, model.longest + 1):
            key = tk.mix(h)
            kind = model.kind[(key >> np.uint64(42)).astype(np.int64)]
            near = np.flatnonzero(kind & 1)
            found, j = key[near], kind[near] >> 2
            same = model.keys[j] == found
            for _ in range(model.crowd - 1):
                other = np.flatnonzero(~same)
                j[other] = np.minimum(j[other] + 1, len(model.keys) - 1)
                same[other] = model.keys[j[other]] == found[other]
            rows, j = at[near[same]], j[same]
            weight, piece = model.weights[j], model.ids[j]
            if size == 1:
                has = np.zeros(n, dtype=bool)
                has[rows] = True
                bare = inner[~has[inner]]
                wide = 1 + (char[bare] >= 0x80).astype(int) + (char[bare] >= 0x800) + (char[bare] >= 0x10000)
                rows, weight = np.concatenate((rows, bare)), np.concatenate((weight, (wide * model.byte_weight).astype(np.float32)))
                piece = np.concatenate((piece, np.full(len(bare), -1, np.int32)))
            hits.append((rows, degree[rows], weight, piece))
            degree[rows] += 1
            going = np.flatnonzero((kind & 2 > 0) & (room > size))
            at, room = at[going], room[going]
            h = h[going] * _BASE + char[at + size] + np.uint64(1)
            if not len(at):
                break
        del h, key, kind, near, found, j, same, going, at, room
        first = np.cumsum(degree, dtype=np.int64) - degree
        arcs = int(first[-1]) + int(degree[-1])
        length, pieces, weights = np.empty(arcs, np.int16), np.empty(arcs, self.piece.room.dtype), np.empty(arcs, np.float32)
        for size, (rows, rank, weight, piece) in enumerate(hits, 1):
            slot = first[rows] + rank
            length[slot], pieces[slot], weights[slot] = size, piece, weight
        del hits
        # States from those nearest to a unit's end on, those with more arcs first, so that the k-th arcs are of the first states.
        most = int(degree.max())
        rank = distance.astype(np.int64) * (most + 1) + (most - degree)
        order = np.argsort(rank.astype(np.uint16) if rank.max() < 1 << 16 else rank, kind="stable")[len(ends) :]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(distance)[1:])))
        begins, degrees = first[order], degree[order]
        target = np.repeat(np.arange(n), degree) + length
        # Log-probability of all ways to a unit's end.
        beta = np.zeros(n, dtype=np.float32)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lo == hi:
                continue
            values = []
            for k, m in enumerate(_with_more(degrees[lo:hi])):
                arc = begins[lo : lo + m] + k
                values.append(weights[arc] + beta[target[arc]])
            top = values[0].copy()
            for v in values[1:]:
                np.maximum(top[: len(v)], v, out=top[: len(v)])
            total = np.zeros(hi - lo, dtype=np.float32)
            for v in values:
                total[: len(v)] += np.exp(v - top[: len(v)])
            beta[order[lo:hi]] = top + np.log(total)
        log = weights + (beta[target] - np.repeat(beta, degree))
        chance, sums = np.exp(log), np.empty(arcs, dtype=np.float32)
        del target, weights
        # The likeliest arc of each state, and the chance of all others together.
        order = np.argsort((most - degree).astype(np.uint16), kind="stable")
        begins = first[order]
        total, best, others = (np.zeros(n, dtype=np.float32) for _ in range(3))
        top = np.zeros(n, dtype=np.int16)
        for k, m in enumerate(_with_more(degree[order])):
            arc = begins[:m] + k
            c = chance[arc]
            total[:m] += c
            sums[arc] = total[:m]
            others[:m] += np.minimum(best[:m], c)
            np.putmask(top[:m], c > best[:m], k)
            np.maximum(best[:m], c, out=best[:m])
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        self.start.add(ends - sizes + self.degree.n)
        self.states.add(sizes + 1)
        self.first.add(first + self.log.n)
        for column, values in ((self.degree, degree), (self.top, top[back]), (self.others, others[back]), (self.char, char), (self.size, length), (self.piece, pieces), (self.log, log), (self.sums, sums)):
            column.add(values)

    def walk(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each state to its unit's end by the conditional probabilities:
        (which of the given, state, arc) of the pieces in order."""
        first, degree, size, sums = self.first.all, self.degree.all, self.size.all, self.sums.all
        which, found, step = np.flatnonzero(degree[states]), [], 0
        at, count = states[which], np.zeros(len(states), dtype=np.int64)
        seeds = seeds[which]
        while len(which):
            low = first[at]
            arc = low + degree[at] - 1
            u = uniform32(seeds + np.uint64(step * 0x2545F4914F6CDD1D % (1 << 64))) * sums[arc]
            # The first arc whose sum is above u; the last one is above it.
            some = np.flatnonzero(arc > low)
            while len(some):
                some = some[sums[arc[some] - 1] > u[some]]
                arc[some] -= 1
                some = some[arc[some] > low[some]]
            found.append((which, at, arc))
            count[which] += 1
            at = at + size[arc]
            alive = np.flatnonzero(degree[at])
            which, at, seeds, step = which[alive], at[alive], seeds[alive], step + 1
        begins = np.cumsum(count) - count
        states, arcs = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for step, (which, at, arc) in enumerate(found):
            place = begins[which] + step
            states[place], arcs[place] = at, arc
        return np.repeat(np.arange(len(count)), count), states, arcs

    def open_siblings(self, paths: list[tuple], before: np.ndarray, bound: np.ndarray, seeds: np.ndarray, many: int) -> list[list[tuple]]:
        """Along each path (states, arcs, log-probabilities) below a node of log-probability
        ``before`` and perturbed value ``bound``, the siblings of each step
        together are one node. The ``many`` best of each path: (-value, place,
        log-probability before it)."""
        out: list[list[tuple]] = [[] for _ in paths]
        sizes = np.array([len(p[0]) for p in paths], dtype=np.int64)
        if not sizes.sum():
            return out
        at, arc, taken = (np.concatenate([p[i] for p in paths]) for i in (0, 1, 2))
        path = np.repeat(np.arange(len(paths)), sizes)
        starts = np.cumsum(sizes) - sizes
        taken = taken.astype(np.float64)
        sums = np.cumsum(taken) - taken
        sums += (before - sums[np.minimum(starts, len(sums) - 1)])[path]
        keep = np.flatnonzero(sums > DEEPEST)
        at, arc, path, taken, sums = at[keep], arc[keep], path[keep], taken[keep], sums[keep]
        with np.errstate(divide="ignore"):
            rest = np.where(arc == self.first.all[at] + self.top.all[at], np.log(self.others.all[at].astype(np.float64)), np.log1p(-np.exp(np.minimum(taken, 0))))
        log = sums + rest
        place = keep - starts[path]
        u = uniform(seeds[path] + (place + 1).astype(np.uint64) * _BASE)
        value = np.where(log > -np.inf, log - np.log(np.exp(np.minimum(log - bound[path], 700)) - np.log(u)), -np.inf)
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        for _ in range(many):
            if not len(path):
                break
            best = np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(path))))
            for i in np.flatnonzero((value == best) & (value > -np.inf)).tolist():
                if len(out[path[i]]) < many:
                    out[path[i]].append((-float(value[i]), int(place[i]), float(sums[i])))
            value = np.where(value == best, -np.inf, value)
        return out

    def split(self, state: int, chosen: int, before: float, bound: float, seed: int) -> tuple[int, float, list[tuple]]:
        """Of the siblings of the arc ``chosen``, the one that has their common
        value ``bound``, its log-probability, and the others as nodes of their
        own: (-value, arc, log-probability)."""
        low = int(self.first.all[state])
        arcs = np.array([a for a in range(low, low + int(self.degree.all[state])) if a != chosen])
        log = self.log.all[arcs].astype(np.float64)
        chance = np.cumsum(np.exp(log - log.max()))
        u = uniform(np.uint64(seed) + np.arange(len(arcs) + 1, dtype=np.uint64) * _SPLIT)
        best = min(int(np.searchsorted(chance, u[0] * chance[-1], side="right")), len(arcs) - 1)
        nodes = []
        for i, (arc, own, v) in enumerate(zip(arcs.tolist(), log.tolist(), u[1:].tolist(), strict=True)):
            if i != best:
                own += before
                nodes.append((-(own - float(np.log(np.exp(min(own - bound, 700)) - np.log(v)))), arc, own))
        return int(arcs[best]), before + float(log[best]), nodes


def _with_more(degrees: np.ndarray) -> list[int]:
    """Of falling numbers: how many are above 0, above 1, and so on."""
    return (len(degrees) - np.cumsum(np.bincount(degrees))[:-1]).tolist()


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1, neither included."""
    return ((tk.mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def uniform32(x: np.ndarray) -> np.ndarray:
    return (tk.mix(x) >> np.uint64(41)).astype(np.float32) * np.float32(2.0**-23)


def segment_chunk(model: PieceModel, texts: list[str], keys: np.ndarray, samples: int) -> list[list[tuple]]:
    """For each text its encoding, then its sampled segmentations:
    (ids, log_prob, perturbed, log_inclusion), the latter three None for the encoding."""
    if not texts:
        return []
    names, occ, bounds = model.all_units(texts)
    units = model.kept(samples > 0)
    occ = units.numbers(names)[occ]
    sizes = units.sizes.all[occ]
    token_at = np.concatenate(([0], np.cumsum(sizes)))
    whole = units.ids.all[spans(units.begins.all[occ], sizes)]
    out = [[(whole[token_at[bounds[d]] : token_at[bounds[d + 1]]], None, None, None)] for d in range(len(texts))]
    if samples:
        _sample(model, units.lattice, occ, bounds, keys, samples, out)
    for d, text in enumerate(texts):
        if SPACE in text:
            out[d] = [(model.repaired(ids, text), *rest) for ids, *rest in out[d]]
    return out


def _sample(model: PieceModel, lattice: Lattice, occ: np.ndarray, bounds: np.ndarray, keys: np.ndarray, samples: int, out: list) -> None:
    n = len(bounds) - 1
    number = np.arange(len(occ)) - np.repeat(bounds[:-1], np.diff(bounds))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    roots = tk.mix(keys.astype(np.uint64) + np.uint64(0x51ED270B))
    frontier: list[list] = [[] for _ in range(n)]
    leaves: list[list[tuple]] = [[] for _ in range(n)]
    for leaf in range(samples):
        seeds = tk.mix(roots + tk.mix(np.array([leaf + 1], dtype=np.uint64)))
        states, todo = lattice.start.all[occ], np.ones(len(occ), dtype=bool)
        nodes: list = [None] * n
        if leaf == 0:
            first = -np.log(-np.log(uniform(roots)))
            nodes = [(float(g), None, 0, 0, 0.0) for g in first]
        else:
            for d in range(n):
                if frontier[d]:
                    value, place, arc, log, parent = heapq.heappop(frontier[d])
                    which, at, taken, _ = leaves[d][parent][0]
                    if arc < 0:
                        arc, log, rest = lattice.split(int(at[place]), int(taken[place]), log, -value, int(seeds[d] ^ np.uint64(0x3C3C3C3C)))
                        for node in rest:
                            heapq.heappush(frontier[d], (node[0], place, *node[1:], parent))
                    nodes[d] = (-value, parent, place, arc, log)
                    o = int(which[place])
                    todo[bounds[d] : o] = False
                    states[o] = at[place] + lattice.size.all[arc]
                else:
                    todo[bounds[d] : bounds[d + 1]] = False
        some = np.flatnonzero(todo)
        which, at, arc = lattice.walk(states[some], tk.mix(seeds[doc[some]] + number[some].astype(np.uint64) * _BASE))
        which, logs = some[which], lattice.log.all[arc]
        cuts = np.searchsorted(which, bounds)
        active = [d for d in range(n) if nodes[d] is not None]
        fresh = dict.fromkeys(active, 0)
        for d in active:
            value, parent, step, chosen, before = nodes[d]
            path = tuple(x[cuts[d] : cuts[d + 1]] for x in (which, at, arc, logs))
            if parent is not None:
                old = leaves[d][parent][0]
                fresh[d] = step + 1
                head = [x[: step + 1].copy() for x in old]
                head[2][step], head[3][step] = chosen, lattice.log.all[chosen]
                path = tuple(np.concatenate(x) for x in zip(head, path, strict=True))
            leaves[d].append((path, float(path[3].sum(dtype=np.float64)), value))
        tails = [tuple(x[fresh[d] :] for x in leaves[d][-1][0][1:]) for d in active]
        values, befores = (np.array([nodes[d][i] for d in active], dtype=np.float64) for i in (0, 4))
        opened = lattice.open_siblings(tails, befores, values, seeds[active] ^ np.uint64(0xA5A5A5A5), samples + 1)
        for d, found in zip(active, opened, strict=True):
            for v, step, log in found:
                heapq.heappush(frontier[d], (v, fresh[d] + step, -1, log, len(leaves[d]) - 1))
    paths = [path for own in leaves for path, _, _ in own]
    states, arcs = (np.concatenate([p[i] for p in paths]) for i in (1, 2))
    ids, ends = lattice.piece.all[arcs].astype(np.int32), np.cumsum([len(p[2]) for p in paths])
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        chars = lattice.char.all[states]
        more = np.zeros(len(ids) + 1, dtype=np.int64)
        more[bare + 1] = (chars[bare] >= 0x80).astype(int) + (chars[bare] >= 0x800) + (chars[bare] >= 0x10000)
        ids, ends = model.with_bytes(ids, chars), ends + np.cumsum(more)[ends]
    pieces = iter(np.split(ids, ends[:-1]))
    for d in range(n):
        kappa = -frontier[d][0][0] if frontier[d] else -np.inf
        for _, log, value in leaves[d]:
            x = log - kappa
            inclusion = 0.0 if np.isinf(kappa) else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
            out[d].append((next(pieces), log, value, min(inclusion, 0.0)))


def piece_model(path: str | None = None) -> PieceModel:
    path = path or DEFAULT
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def segmentations(docs: DataFrame, samples: int = SAMPLES, model_path: str | None = None) -> DataFrame:
    """Rows (doc_id, sample, n_pieces, ids, log_prob, perturbed, log_inclusion,
    restored) for every row of ``docs`` and its whole text.

    sample 0 is the library's encoding; samples 1 to ``samples`` are distinct
    segmentations in falling order of ``perturbed``, fewer if the text has
    fewer. ``ids`` are little-endian, of two bytes if the vocabulary allows,
    else four. log_inclusion is the logarithm of the inclusion score.
    ``restored`` tells whether decoding gives the text back. Null counts as
    empty; an empty text has no piece and one segmentation. Rows of equal keys
    and texts get equal samples; a null key counts as 0. Empty tables give
    empty results; further columns are not read."""

    def run(batches):
        model = piece_model(model_path)
        width = "<u2" if len(model.pieces) <= 1 << 16 else "<i4"
        try:
            for batch in batches:
                ids, column = batch.column("doc_id"), batch.column("_text")
                keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                _, offsets = tk.buffers(column)
                for lo, hi in tk.chunks(offsets, CHUNK_BYTES):
                    texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                    rows: list[tuple] = []
                    parts = segment_chunk(model, texts, keys[lo:hi], samples)
                    back = iter(model.decode_all([x[0] for found in parts for x in found]))
                    for i, found in enumerate(parts):
                        raw, own = texts[i].encode(), ids[lo + i].as_py()
                        rows += [(own, s, len(x), x.astype(width).tobytes(), a, b, c, next(back) == raw) for s, (x, a, b, c) in enumerate(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    del rows, parts, back
                    if offsets[hi] - offsets[lo] > CHUNK_BYTES:  # one long text
                        tk.release()
        finally:  # the worker may go on to other work
            model.known.clear()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return source.mapInArrow(tk.tidy(run), "doc_id long, sample int, n_pieces int, ids binary, log_prob double, perturbed double, log_inclusion double, restored boolean")


ARROW = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int32()), ("ids", pa.binary()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("restored", pa.bool_())])


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, sample, text) from rows with doc_id, sample and ids as above;
    null ids give null."""

    def run(batches):
        model = piece_model(model_path)
        width = "<u2" if len(model.pieces) <= 1 << 16 else "<i4"
        for batch in batches:
            texts = [None if x is None else model.decode_bytes(np.frombuffer(x, width)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return encoded.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")


def digests(docs: DataFrame) -> DataFrame:
    found = segmentations(docs)
    return found.select("doc_id", "sample", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "log_prob", "perturbed", "log_inclusion", "restored")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
