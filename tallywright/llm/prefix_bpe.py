"""Operator 13: byte-level BPE by dynamic programming over prefixes.

Merging by lowest rank gives every byte prefix of a piece one encoding, and the
encoding of a prefix is a prefix of encodings: if token t ends the encoding of
``piece[:i]``, what is before it is the encoding of ``piece[:i - len(t)]``. So one
token per prefix, its last one, holds the encodings of all prefixes. Of the
tokens that end at ``i``, the valid one is that whose pair with the last token of
the prefix before it encodes to itself; exactly one does (a merge that crossed a
boundary of the sequence would cross it in that pair too).

The table makes appends exact (go on where it ends) and edits cheap: pieces of
the pattern before and after an edit stay, and within a piece the table is
computed anew only until it agrees with the old one for as many places as the
longest token has bytes.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections import ChainMap
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .exact_dedup import sha256
from .runtime import table
from .wordpieces import DEFAULT, PATTERN

#: What a worker remembers: verdicts on pairs, and encodings of short pieces.
PAIRS, PIECES, PIECE_BYTES = 1 << 20, 1 << 19, 64
CHUNK_BYTES, DECODED_IDS = 1 << 20, 1 << 18


class Vocabulary:
    """Ranks of a byte-level vocabulary, which has every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest, self.stride = max(map(len, ranks)), max(ranks.values()) + 1
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, ...]] = {}
        self._flat: tuple[np.ndarray, pa.Array] | None = None
        self._child: np.ndarray | None = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merged(self, text: bytes, least: int = 1) -> list[bytes]:
        """Parts of a short text by the definition of its encoding: merge the leftmost
        pair of lowest rank until there is none, or ``least`` parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > least:
            ranked = [(self.ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in self.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, ...]:
        """The two tokens that merge into ``token`` last; none for a single byte or
        where that isn't one merge of two tokens of lower rank."""
        found = self._halves.get(token)
        if found is None:
            parts = [self.ranks[p] for p in self.merged(self.tokens[token], 2)]
            found = self._halves[token] = tuple(parts) if len(parts) == 2 and max(parts) < token else ()
        return found

    def _judged(self, before: int, token: int) -> bool:
        """Whether the pair encodes to itself: go back over the merges that made it,
        the latest first, and see whether one across its boundary came before. As
        long as parts have lower ranks than wholes, merges happen in order of rank;
        else the definition decides."""
        left, right, bound = before, token, self.stride
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            later_left = left > right
            if self.lengths[left if later_left else right] == 1:
                later_left = not later_left
            if self.lengths[left if later_left else right] == 1:
                return True
            halves = self.halves(left if later_left else right)
            if not halves:
                return self.merged(self.tokens[before] + self.tokens[token]) == [self.tokens[before], self.tokens[token]]
            if later_left:
                left, bound = halves[1], left
            else:  # of equal ranks the left one merges first
                right, bound = halves[0], right + 1

    def fits(self, token: int, before: int = -1) -> bool:
        """Whether ``token``, alone or after the token ``before``, is the encoding of
        its bytes."""
        key = (before + 1) * self.stride + token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._judged(before, token) if before >= 0 else self.merged(self.tokens[token]) == [self.tokens[token]]
        return known

    def extend(self, last: array, piece: bytes, old: array | None = None, shift: int = 0, since: int = 0) -> int:
        """Fill ``last`` (token of each prefix of ``piece``, from 1 byte on) up to the
        end. ``old`` is a table of another text that has the bytes of ``piece`` from
        place ``since`` on at places less by ``shift``: from where as many of these
        places agree as the longest token has bytes, the rest is taken from it.
        Returns how many places were computed."""
        begin = place = len(last)
        window, agree = max(0, begin - self.longest), 0
        known, stride, append = self._fits.get, self.stride, last.append
        for end, (token, length) in self.endings.iter((piece[window:] if window else piece).decode("latin-1")):
            if end + window != place:  # known, or found by a longer token
                continue
            before = last[place - length] if length <= place else -1
            fits = known((before + 1) * stride + token)
            if not (self.fits(token, before) if fits is None else fits):
                continue
            append(token)
            if old is not None and place >= since:
                agree = agree + 1 if old[place - shift] == token else 0
                if agree >= self.longest:
                    last.extend(old[place + 1 - shift : len(piece) - shift])
                    return place + 1 - begin
            place += 1
        return place - begin

    def read_out(self, last: array) -> list[int]:
        """The tokens of the whole piece, from the last one back."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.lengths[ids[-1]]
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, even if merging would
        not lead to it."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = array("i")
        self.extend(last, piece)
        return self.read_out(last)

    def _prepare(self) -> None:
        """What the encoding of many pieces at once looks up, as arrays: the tree of
        all beginnings of tokens, lengths, halves, and tokens by two that make them."""
        inner = {b"": 0}
        for token in self.ranks:
            for k in range(1, len(token)):
                inner.setdefault(token[:k], len(inner))
        number = dict(inner)
        for token in self.ranks:
            number.setdefault(token, len(number))
        self._child = np.full((len(inner), 256), -1, dtype=np.int32)
        self._rank = np.full(len(number), -1, dtype=np.int32)
        for name, node in number.items():
            if name:
                self._child[inner[name[:-1]], name[-1]] = node
                self._rank[node] = self.ranks.get(name, -1)
        self._length = np.zeros(self.stride, dtype=np.int32)
        self._length[list(self.lengths)] = list(self.lengths.values())
        #: -2 where not looked at yet, -1 where there is none.
        self._left, self._right = np.full(self.stride, -2, dtype=np.int32), np.full(self.stride, -2, dtype=np.int32)
        get, made = self.ranks.get, []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    made.append((left * self.stride + right, rank))
        keys, ranks = np.array(sorted(made), dtype=np.int64).reshape(-1, 2).T
        self._pairs, self._made = np.ascontiguousarray(keys), ranks.astype(np.int32)
        self._slots, self._verdicts = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)
        del inner, number, made
        tk.release()

    def _judge(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`_judged` of many pairs, all of which take their steps together."""
        out, which = np.zeros(len(token), dtype=bool), np.arange(len(token))
        alone = np.flatnonzero(before < 0)
        out[alone] = [self.merged(self.tokens[t]) == [self.tokens[t]] for t in token[alone].tolist()]
        which = which[before >= 0]
        left, right, bound = before[which], token[which], np.full(len(which), self.stride)
        while len(which):
            key = left.astype(np.int64) * self.stride + right
            at = np.searchsorted(self._pairs, key).clip(max=max(len(self._pairs) - 1, 0))
            across = np.where(self._pairs[at] == key, self._made[at], self.stride) if len(self._pairs) else np.full(len(key), self.stride)
            later = left > right
            later ^= self._length[np.where(later, left, right)] == 1
            split = np.where(later, left, right)
            crossed, single = across < bound, self._length[split] == 1
            out[which[~crossed & single]] = True
            go = ~crossed & ~single
            for t in np.unique(split[go & (self._left[split] == -2)]).tolist():
                self._left[t], self._right[t] = self.halves(t) or (-1, -1)
            for i in which[go & (self._left[split] == -1)].tolist():
                out[i] = self._judged(int(before[i]), int(token[i]))
            go &= self._left[split] >= 0
            which, left, right, later, split = which[go], left[go], right[go], later[go], split[go]
            bound = np.where(later, split, split + 1)
            left, right = np.where(later, self._right[split], left), np.where(later, right, self._left[split])
        return out

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`fits` of many pairs. Verdicts are kept in as many places as PAIRS, by a hash."""
        key = (before.astype(np.int64) + 1) * self.stride + token
        place = (tk.mix(key.view(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
        out = self._verdicts[place]
        new = np.flatnonzero(self._slots[place] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = new[first]
            verdict = self._judge(before[found], token[found])
            out[new] = verdict[back]
            self._slots[place[found]] = key[found]
            self._verdicts[place[found]] = verdict
            # A place that several of them take is left empty.
            lost = found[self._slots[place[found]] != key[found]]
            self._slots[place[lost]] = -1
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of many short pieces, end to end, and their sizes: the last
        tokens of all prefixes of one length are found together."""
        if self._child is None:
            self._prepare()
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=n)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(n), sizes)
        at = np.flatnonzero(whole[piece] < 0)
        room = (begins + sizes)[piece[at]] - at
        # Tokens that begin at each byte, by the byte after them.
        node, hits, size = np.zeros(len(at), dtype=np.int32), [], 0
        while len(at):
            node = self._child[node, data[at + size]]
            size += 1
            rank = self._rank[node]
            near = np.flatnonzero((node >= 0) & (rank >= 0))
            hits.append((at[near], np.full(len(near), size), rank[near]))
            going = (node >= 0) & (node < len(self._child)) & (room > size)
            at, node, room = at[going], node[going], room[going]
        last = np.full(len(data) + 1, -1, dtype=np.int32)  # of the prefix that ends at each byte; behind all: none
        if hits:
            start, size, rank = (np.concatenate(x) for x in zip(*hits, strict=True))
            end = start + size - 1
            place = end - begins[piece[end]]
            order = np.argsort(place.astype(np.int16), kind="stable")
            start, end, rank, first = start[order], end[order], rank[order], (start == begins[piece[start]])[order]
            bounds = np.cumsum(np.bincount(place))
            for a, b in zip([0, *bounds[:-1]], bounds, strict=True):
                before = last[np.where(first[a:b], len(data), start[a:b] - 1)]
                fits = self._fit(before, rank[a:b])
                last[end[a:b][fits]] = rank[a:b][fits]
        # Read out from the ends back.
        alone = np.flatnonzero(whole >= 0)
        which = np.flatnonzero(whole < 0)
        found, at = [(alone, np.zeros(len(alone), np.int64), whole[alone])], (begins + sizes)[which]
        while len(which):
            rank = last[at - 1]
            found.append((which, at, rank))
            at = at - self._length[rank]
            more = at > begins[which]
            which, at = which[more], at[more]
        which, at, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        return rank[np.lexsort((at, which))], np.bincount(which, minlength=n)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids: tokens laid end to end, cut where lists end."""
        if self._flat is None:
            ranks = sorted(self.tokens)
            self._flat = np.array(ranks, dtype=np.int32), pa.array([self.tokens[r] for r in ranks], pa.large_binary())
        ranks, tokens = self._flat
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        flat, out = lists.flatten(), [pa.array([], pa.binary())]
        for lo, hi in tk.chunks(bounds, DECODED_IDS):
            ids = flat.slice(bounds[lo], bounds[hi] - bounds[lo]).to_numpy(zero_copy_only=False)
            place = np.searchsorted(ranks, ids).clip(max=len(ranks) - 1)
            if (ranks[place] != ids).any():
                raise KeyError(ids[ranks[place] != ids][0])
            found = tokens.take(pa.array(place))
            _, offsets, data = found.buffers()
            at = np.frombuffer(offsets, np.int64)[bounds[lo : hi + 1] - bounds[lo]] if len(ids) else np.zeros(hi - lo + 1, np.int64)
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at), data]).cast(pa.binary()))
        return pa.concat_arrays(out)


class Document:
    """A text with its pieces and their tables, kept up to date by edits.

    ``starts`` are the pieces' first characters, ``tables`` their last tokens by
    byte prefix. ``computed`` counts the table places computed so far.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = "", pattern: str = PATTERN, state: tuple[list[int], list[array]] | None = None):
        self.vocabulary, self.pattern, self.text, self.computed = vocabulary, regex.compile(pattern), text, 0
        if state is not None:
            self.starts, self.tables = state
            return
        self.starts, self.tables = [], []
        for m in self.pattern.finditer(text):
            self.starts.append(m.start())
            self.tables.append(self._table(m.group().encode()))

    def _table(self, piece: bytes, known: array | None = None, *old) -> array:
        last = known if known is not None else array("i")
        self.computed += self.vocabulary.extend(last, piece, *old)
        return last

    def _piece(self, i: int) -> str:
        return self.text[self.starts[i] : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, at: int, until: int, new: str) -> None:
        """Replace characters ``at`` to ``until`` by ``new``.

        A match of the pattern is settled by at most two characters after it (a
        contraction takes two beyond its apostrophe), so pieces that end two or
        more before ``at`` stay. Behind the edit, matches are found anew until one
        begins where one of the old ones did; from there on all are the old ones.
        """
        if not 0 <= at <= until <= len(self.text):
            raise ValueError(f"no characters {at} to {until} in a text of {len(self.text)}")
        text, grown = self.text[:at] + new + self.text[until:], len(new) - (until - at)
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        first = next((i for i, e in enumerate(ends) if e > at - 2), len(ends))
        old_at = {s + grown: i for i, s in enumerate(self.starts) if s >= until}
        starts, tables, rest = [], [], len(self.starts)
        place = self.starts[first] if first < len(self.starts) else (ends[-1] if ends else 0)
        for m in self.pattern.finditer(text, place):
            if m.start() >= at + len(new) and m.start() in old_at:
                rest = old_at[m.start()]
                break
            starts.append(m.start())
            tables.append(self._around(m.group(), m.start(), at, until, grown))
        kept = self.starts[rest:]
        self.starts = [*self.starts[:first], *starts, *(s + grown for s in kept)]
        self.tables = [*self.tables[:first], *tables, *self.tables[rest:]]
        self.text = text

    def _around(self, piece: str, start: int, at: int, until: int, grown: int) -> array:
        """Table of a piece near an edit: places before the edit are those of the old
        piece of the same start; places behind it can come from the old piece that
        held its last character."""
        raw, size = piece.encode(), lambda text: len(text.encode())
        known, i = array("i"), bisect_left(self.starts, start)
        if start < at and i < len(self.starts) and self.starts[i] == start:
            same = min(len(self._piece(i)), len(piece), at - start)
            known = self.tables[i][: size(piece[:same])]
        end = start + len(piece) - grown
        if end <= until:
            return self._table(raw, known)
        j = bisect_right(self.starts, end - 1) - 1
        shared = max(start, until + grown, self.starts[j] + grown)
        return self._table(raw, known, self.tables[j], len(raw) - size(self.text[self.starts[j] : end]), size(piece[: shared - start]))

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self._ids(i, t) for i, t in enumerate(self.tables)))

    def _ids(self, i: int, last: array) -> list[int]:
        rank = self.vocabulary.ranks.get(self._piece(i).encode()) if len(last) <= self.vocabulary.longest else None
        return [rank] if rank is not None else self.vocabulary.read_out(last)


class Pieces:
    """Encodings of pieces by their text. Short ones are kept, under numbers: the
    ids of piece k are ``flat[begins[k] : begins[k + 1]]``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.begins = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.number)

    def __getitem__(self, piece: str) -> list[int]:
        k = self.number.get(piece)
        return self.vocabulary.encode_piece(piece.encode()) if k is None else self.flat[self.begins[k] : self.begins[k + 1]].tolist()

    def learn(self, pieces: Iterable[str]) -> list[str]:
        """Encode the short ones of ``pieces`` that aren't known, all at once.
        Returns the long ones."""
        new, long, raws = [], [], []
        for piece in set(pieces).difference(self.number):
            raw = piece.encode()
            if len(raw) > PIECE_BYTES:
                long.append(piece)
            else:
                new.append(piece)
                raws.append(raw)
        self.number.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        flat, sizes = self.vocabulary.encode_pieces(raws)
        self.flat, self.begins = np.concatenate((self.flat, flat)), np.concatenate((self.begins, self.begins[-1] + np.cumsum(sizes)))
        return long

    def lists(self, found: list[list[str]]) -> pa.ListArray:
        """The ids of each text, whose pieces are given."""
        pieces = list(chain.from_iterable(found))
        long = self.learn(pieces)
        flat, begins, number = self.flat, self.begins, self.number.__getitem__
        if long:
            ids = [np.array(self.vocabulary.encode_piece(piece.encode()), dtype=np.int32) for piece in long]
            flat, begins = np.concatenate((flat, *ids)), np.concatenate((begins, begins[-1] + np.cumsum([len(x) for x in ids])))
            number = ChainMap(self.number, dict(zip(long, range(len(self), len(self) + len(long)), strict=True))).__getitem__
        at = np.fromiter(map(number, pieces), np.int64, len(pieces))
        sizes = (begins[1:] - begins[:-1])[at]
        until = np.concatenate(([0], np.cumsum(sizes)))
        ids = flat[np.arange(until[-1]) + np.repeat(begins[at] - until[:-1], sizes)]
        texts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        return pa.ListArray.from_arrays(pa.array(until[texts].astype(np.int32)), pa.array(ids))


_loaded: dict[str, Vocabulary] = {}
_known: dict[str, Pieces] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    path = path or DEFAULT
    if path not in _loaded:
        _loaded[path] = Vocabulary.read(path)
    return _loaded[path]


def known_pieces(path: str | None = None) -> Pieces:
    """The pieces that this worker has learned, in earlier tasks too: most of a
    task's pieces have occurred in others."""
    path = path or DEFAULT
    if path not in _known:
        _known[path] = Pieces(vocabulary(path))
    return _known[path]


def _lists(rows: Iterator[Iterable[int]]) -> pa.Array:
    flat, bounds = array("i"), array("i", [0])
    for row in rows:
        flat.extend(row)
        bounds.append(len(flat))
    whole = lambda numbers: pa.array(np.frombuffer(numbers, dtype=np.int32) if numbers else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(whole(bounds), whole(flat))


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of each row: the token ids of its whole text, without special
    tokens; their strings are ordinary text.

    A null text counts as empty and has no ids. Rows that repeat an id or have
    none are each encoded. A piece of any length takes time in proportion to it. An
    empty table gives no row. Other columns are ignored, whatever their names.
    """

    def run(batches):
        words, find = known_pieces(path), regex.compile(pattern).findall
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            _, offsets = tk.buffers(texts)
            for lo, hi in tk.chunks(offsets, CHUNK_BYTES):
                ids = words.lists([find(t.as_py()) for t in texts.slice(lo, hi - lo)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["doc_id", "ids"])
                if len(words) > PIECES:
                    words.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tk.tidy(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their token ids; null ids are none."""
    fields = [f for f in rows.schema.fields if f.name != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"
    kept, at = [f.name for f in fields], [f.name for f in fields].index(ids_col)

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, words.decode_lists(batch.column(at))], names=[*kept, "decoded"])

    return rows.select(*kept).mapInArrow(run, schema)


TABLES = "doc_id long, text string, starts array<int>, last array<int>, ids array<int>"


def _table_batch(names: list, documents: list[Document]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.int64()), pa.array([d.text for d in documents], pa.string()),
            _lists(d.starts for d in documents), _lists(chain.from_iterable(d.tables) for d in documents), _lists(d.ids() for d in documents),
        ], names=["doc_id", "text", "starts", "last", "ids"],
    )


def tables(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Each text with what :func:`revised` needs: first characters of its pieces, and
    for each byte the last token of the prefix of its piece that ends there."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _table_batch([name], [Document(vocabulary(path), text.as_py() or "", pattern)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tk.tidy(run), TABLES)


def revised(stored: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``stored`` rows of :func:`tables` with columns ``at``, ``until`` and ``new`` added
    (characters to replace, and by what), after that edit. A null ``at`` is the end
    of the text (an append), a null ``until`` is ``at``, a null ``new`` is empty. Only
    pieces near an edit are encoded again."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"] or ""
                ends = [*row["starts"][1:], len(text)]
                tables, begin = [], 0
                for a, b in zip(row["starts"], ends, strict=False):
                    size = len(text[a:b].encode())
                    tables.append(array("i", row["last"][begin : begin + size]))
                    begin += size
                document = Document(vocabulary(path), text, pattern, (list(row["starts"]), tables))
                at = len(text) if row["at"] is None else row["at"]
                document.edit(at, at if row["until"] is None else row["until"], row["new"] or "")
                yield _table_batch([row["doc_id"]], [document])

    return stored.select("doc_id", "text", "starts", "last", F.col("at").cast("int"), F.col("until").cast("int"), "new").mapInArrow(tk.tidy(run), TABLES)


def digests(rows: DataFrame) -> DataFrame:
    """Token count and digests of ``rows`` with ids and decoded."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decoded(encoded(table(spark, sf_dir, "documents"), path, pattern=public_tokenizers.PATTERN), path))
