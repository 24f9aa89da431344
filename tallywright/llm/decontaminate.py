"""Operator 4: benchmark decontamination by the q-gram lemma.

Every region of a window's length of a benchmark item is looked for, wherever it
begins; a shorter item as a whole. A text region within
``e`` edits of a window of ``w`` characters shares at least ``w - q + 1 - e*q``
of its q-grams with it, all within ``e`` diagonals of each other. So the shared
q-grams are counted in diagonal bands of ``2e`` diagonals that overlap by half,
bands that reach the bound are kept, and a banded alignment decides: first of
windows half a window apart, and if none is found, of those between them.
Items too short for that are compared exactly, at the bounds of words.
Texts are compared in lower case with white space folded, whole texts always.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import table

Q, WINDOW, EDITS, LEAST_HITS, LEAST_CHARS = 12, 120, 0.065, 4, 25
TABLE_BITS = 22
#: Characters of benchmark text that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000

#: Pairs of a text's q-gram and a place of it in an item that are expanded at once.
SLICE_HITS = 500_000

#: Edits over the budget that an alignment tells apart, to pass over windows that can't be found.
OVER = 16

_tables: list[np.ndarray] = []
_words: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Lower case of the basic plane, white space as 32; lengths never change."""
    if not _tables:
        out = np.arange(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            if not 0xD800 <= i <= 0xDFFF:
                low = chr(i).lower()
                out[i] = 32 if chr(i).isspace() else ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def _in_word() -> np.ndarray:
    """Whether a code point is a letter or digit of a script that divides words."""
    if not _words:
        out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
        out[0x0E00:0x0E80] = out[0x3040:0xA000] = out[0x20000:] = False
        _words.append(out)
    return _words[0]


def normal_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row bounds of texts in lower case, runs of white space
    as one space, none at either end."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = np.where(codes < (1 << 16), _lower()[codes & 0xFFFF], codes)
    solid = codes != 32
    last = np.zeros(len(codes) + 1, dtype=bool)
    last[at] = True
    keep = solid.copy()
    keep[:-1] |= solid[1:] & ~last[1:-1]  # the space before a word, unless it begins a row
    keep[at[:-1][at[:-1] < len(codes)]] &= solid[at[:-1][at[:-1] < len(codes)]]
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q characters at each place, by the low byte of each: equal
    strings have equal values, and the alignment weeds out the rest."""
    low = (codes & 0xFF).astype(np.uint8).tobytes()
    n = len(low) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((n + Q - 8,), dtype="<u8", buffer=low, strides=(1,))
    return tk.mix(eight[:n]) + eight[Q - 8 :]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits between ``pattern`` and a piece of ``text``, along diagonals
    low..high (text place minus pattern place): (edits, begin, end), or None if
    over ``most``. The piece may begin and end anywhere inside the band."""
    width = high - low + 1
    steps = np.arange(width)
    big = 1 << 20
    at = steps + low
    cost = np.where((at >= 0) & (at <= len(text)), 0, big)
    rows = np.empty((len(pattern) + 1, width), dtype=np.int64)
    rows[0] = cost
    for i, c in enumerate(pattern):
        at = steps + low + i
        inside = (at >= 0) & (at < len(text))
        diagonal = rows[i] + np.where(inside, text[at.clip(0, max(len(text) - 1, 0))] != c, big) if len(text) else rows[i] + big
        dropped = np.append(rows[i][1:], big) + 1
        best = np.minimum(diagonal, dropped)
        end = steps + low + i + 1
        best = np.where((end >= 0) & (end <= len(text)), best, big)
        rows[i + 1] = np.minimum(np.minimum.accumulate(best - steps) + steps, big)
        if rows[i + 1].min() > most:
            return None
    d = int(rows[-1].argmin())
    edits, end = int(rows[-1][d]), d + low + len(pattern)
    for i in range(len(pattern), 0, -1):  # back to where it begins
        while d and rows[i][d] == rows[i][d - 1] + 1 and rows[i][d] <= big:
            diagonal = rows[i - 1][d]
            place = d + low + i - 1
            if 0 <= place < len(text) and rows[i][d] == diagonal + (text[place] != pattern[i - 1]):
                break
            d -= 1
        place = d + low + i - 1
        if not (0 <= place < len(text) and rows[i][d] == rows[i - 1][d] + (text[place] != pattern[i - 1])) and d + 1 < width:
            d += 1
    return edits, d + low, end


@dataclass
class Windows:
    """The regions of an item that are looked for: (begin, length, edits, least hits)."""

    chars: int
    length: int
    edits: int

    @property
    def need(self) -> int:
        return self.length - Q + 1 - self.edits * Q

    def __len__(self) -> int:
        return self.chars - self.length + 1

    def __iter__(self):
        return ((b, self.length, self.edits, self.need) for b in range(len(self)))

    def marks(self):
        """Those that begin at multiples of half a window, and the last."""
        begins = sorted({*range(0, len(self), max(1, self.length // 2)), len(self) - 1})
        return ((b, self.length, self.edits, self.need) for b in begins)


@dataclass
class Index:
    """Q-grams of benchmark items, sorted, with the places where they occur."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    names: np.ndarray
    first: np.ndarray
    items: np.ndarray
    places: np.ndarray
    windows: list[Windows]
    span: int
    least: int
    short_ids: list
    shorts: dict[bytes, list[int]]  # code points of a short item: its places in short_ids

    def table(self) -> np.ndarray:
        hit = np.zeros(1 << TABLE_BITS, dtype=bool)
        hit[(tk.mix(self.names) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return hit


def build_index(items: list[tuple], window: int = WINDOW, edits: float = EDITS) -> Index | None:
    """Index (id, text) pairs; items under LEAST_CHARS characters apart. Items of white space have no text."""
    ids, codes, windows, short_ids, shorts = [], [], [], [], {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        own, _ = normal_codes(raw, np.array([0, len(raw)]))
        if len(own) < LEAST_CHARS:
            if len(own):
                shorts.setdefault(own.astype(np.uint32).tobytes(), []).append(len(short_ids))
                short_ids.append(item)
            continue
        w = min(len(own), window)
        e = max(0, min(int(edits * w), (w - Q + 1 - LEAST_HITS) // Q))
        ids.append(item)
        codes.append(own)
        windows.append(Windows(len(own), w, e))
    if not ids and not short_ids:
        return None
    found = [grams(c) for c in codes]
    values = np.concatenate([np.empty(0, np.uint64), *found])
    order = np.argsort(values, kind="stable")
    names, first = np.unique(values[order], return_index=True)
    items_ = np.repeat(np.arange(len(ids)), [len(g) for g in found])[order]
    places = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in found)])[order]
    span, least = max((w.length + 2 * w.edits for w in windows), default=1), min((w.need for w in windows), default=1)
    return Index(ids, codes, np.array([w.edits for w in windows], dtype=np.int64), names, np.append(first, len(values)), items_, places, windows, span, least, short_ids, shorts)


def whole(index: Index, codes: np.ndarray, bounds: np.ndarray):
    """(row, item, begin, end, 0) of every place where a text holds a short item
    between bounds of words; items are numbered after those with windows."""
    if not index.shorts or not len(codes):
        return
    inside = _in_word()[codes.clip(max=0x10FFFF)]
    at_bound = np.ones(len(codes) + 1, dtype=bool)
    at_bound[1:-1] = ~(inside[1:] & inside[:-1])
    at_bound[bounds] = True
    starts = np.flatnonzero(at_bound[:-1])
    rows = np.searchsorted(bounds, starts, side="right") - 1
    lengths: dict = {}
    for own in index.shorts:
        lengths.setdefault(len(own) // 4, []).append(np.frombuffer(own, np.uint32))
    for n, items in lengths.items():
        fits = starts + n <= bounds[rows + 1]
        begin, row = starts[fits], rows[fits]
        ends = at_bound[begin + n]
        begin, row = begin[ends], row[ends]
        names = np.array([tk.span_hashes(x, np.array([0]), np.array([n]))[0] for x in items])
        same = np.isin(tk.span_hashes(codes, begin, begin + n), names)
        for b, r in zip(begin[same].tolist(), row[same].tolist(), strict=True):
            for it in index.shorts.get(codes[b : b + n].astype(np.uint32).tobytes(), ()):
                yield r, len(index.ids) + it, b - int(bounds[r]), b - int(bounds[r]) + n, 0


def between(own: Windows, pattern: np.ndarray, text: np.ndarray, places: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
    """The first window of an item that is within its edits of a piece of
    ``text``, by shared q-grams of one band: (begin, end, edits). A window that is
    ``d`` edits over its budget rules out the next ``d - 1``."""
    places = np.sort(places)
    begins = np.arange(len(own))
    hits = np.searchsorted(places, begins + own.length - Q, side="right") - np.searchsorted(places, begins)
    low, high = int(diagonals.min()) - own.edits - OVER, int(diagonals.max()) + own.edits + OVER
    after = 0
    for b in np.flatnonzero(hits >= own.need).tolist():
        if b < after:
            continue
        found = banded_distance(pattern[b : b + own.length], text, low + b, high + b, own.edits + OVER)
        if found and found[0] <= own.edits:
            return max(found[1], 0), found[2], found[0]
        after = b + (found[0] - own.edits if found else OVER + 1)
    return None


def regions(index: Index, hit: np.ndarray, codes: np.ndarray, bounds: np.ndarray):
    """(row, item, begin, end, edits) of windows found in each text: of all that
    are half a window apart, or if an item has none of these there, of one
    between them. Places are code points of the normalised text."""
    g = grams(codes)
    if not len(g) or not len(index.ids):
        return
    mask = hit[(tk.mix(g) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    total = np.concatenate(([0], np.cumsum(mask)))
    ends = np.minimum(np.arange(len(g)) + index.span, len(g))
    dense = np.flatnonzero(total[ends] - total[:-1] >= index.least)
    if not len(dense):
        return
    near = np.bincount(dense, minlength=len(g) + 1) - np.bincount(ends[dense], minlength=len(g) + 1)
    at = np.flatnonzero(mask & (np.cumsum(near)[:-1] > 0))
    j = np.searchsorted(index.names, g[at]).clip(max=len(index.names) - 1)
    same = index.names[j] == g[at]
    at, j = at[same], j[same]
    rows = np.searchsorted(bounds, at, side="right") - 1
    inside = at + Q <= bounds[rows + 1]
    at, j, rows = at[inside], j[inside], rows[inside]
    if not len(at):
        return
    by_item: dict[int, np.ndarray] = {}
    done: list[tuple[int, int, int, set]] = []  # (row, item, band, (window, begin)) of the last few bands
    seen, left = set(), []
    for r, it, band in kept_bands(index, at, j, rows, bounds):
        if it not in by_item:
            if len(by_item) > 1000:
                by_item.clear()
            by_item[it] = grams(index.codes[it])
        own = index.windows[it]
        place, diagonal = band_hits(g[bounds[r] : max(bounds[r + 1] - Q + 1, bounds[r])], by_item[it], band, max(own.edits, 1))
        text = codes[bounds[r] : bounds[r + 1]]
        if len(own) > 1:
            left.append((r, it, band))
        done = [x for x in done if x[:2] == (r, it) and x[2] >= band - 4]
        before, now = [x[3] for x in done], set()
        done.append((r, it, band, now))
        for b, w, e, need in own.marks():
            lo, hi = np.searchsorted(place, (b, b + w - Q + 1))
            if hi - lo < need:
                continue
            pattern, near = index.codes[it][b : b + w], diagonal[lo:hi]
            main = int(np.median(near))
            piece = text[max(main + b, 0) : main + b + w]
            if len(piece) == w and np.array_equal(piece, pattern):
                found = (0, main + b, main + b + w)
            else:
                result = banded_distance(pattern, text, int(near.min()) - e + b, int(near.max()) + e + b, e)
                found = result and (result[0], max(result[1], 0), result[2])
            if found and found[0] <= e and (b, found[1]) not in now and not any((b, found[1]) in x for x in before):
                now.add((b, found[1]))
                seen.add((r, it))
                yield r, it, found[1], found[2], found[0]
    for r, it, band in left:
        if (r, it) in seen:
            continue
        place, diagonal = band_hits(g[bounds[r] : max(bounds[r + 1] - Q + 1, bounds[r])], grams(index.codes[it]), band, max(index.windows[it].edits, 1))
        if found := between(index.windows[it], index.codes[it], codes[bounds[r] : bounds[r + 1]], place, diagonal):
            seen.add((r, it))
            yield r, it, *found


def kept_bands(index: Index, at: np.ndarray, j: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, band) in which as many q-grams are shared as some window of
    the item needs; ``at`` are places of q-grams in order, ``j`` their numbers in the index.

    Hits are expanded in slices. A band that the text has passed by more than an
    item's length gets no more hits, so it is kept or dropped then: memory is that
    of a slice and of the bands still open, however often a q-gram repeats."""
    longest = max(len(c) for c in index.codes)
    deep = int(max(np.diff(bounds).max(), 1) + longest) + 4
    shift = longest + 2
    least = np.array([own.need for own in index.windows])
    steps = np.maximum(index.edits, 1)
    count = index.first[j + 1] - index.first[j]
    total = np.cumsum(count)
    open_keys, open_counts, kept = np.empty(0, np.int64), np.empty(0, np.int64), []
    expanded, end = 0, int(total[-1])
    while expanded < end:
        upto = min(expanded + SLICE_HITS, end)
        lo, hi = (int(np.searchsorted(total, x, side="right")) for x in (expanded, upto - 1))
        hit = np.repeat(np.arange(lo, hi + 1), np.minimum(total[lo : hi + 1], upto) - np.maximum(total[lo : hi + 1] - count[lo : hi + 1], expanded))
        posting = index.first[j[hit]] + np.arange(expanded, upto) - (total[hit] - count[hit])
        item, row = index.items[posting], rows[hit]
        band = np.floor_divide(at[hit] - bounds[row] - index.places[posting], steps[item])
        # A hit counts in its band and in the one before, which overlap by half.
        base = (row * len(index.ids) + item) * deep + band + shift
        keys, inverse = np.unique(np.concatenate((open_keys, base, base - 1)), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((open_counts, np.ones(2 * len(base)))), len(keys)).astype(np.int64)
        expanded = upto
        of_row, item = keys // deep // len(index.ids), keys // deep % len(index.ids)
        last = at[hi] - bounds[rows[hi]] - longest  # no hit to come has a lower diagonal in this row
        passed = (of_row < rows[hi]) | ((keys % deep - shift + 2) * steps[item] <= last) if expanded < end else np.ones(len(keys), dtype=bool)
        kept.append(keys[passed & (counts >= least[item])])
        open_keys, open_counts = keys[~passed], counts[~passed]
    keys = np.sort(np.concatenate(kept))
    return [(k // deep // len(index.ids), k // deep % len(index.ids), k % deep - shift) for k in keys.tolist()]


def band_hits(text: np.ndarray, own: np.ndarray, band: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, diagonal) of the q-grams that a text and an item share in a band of
    two steps of diagonals, by place; read off along each diagonal."""
    found = []
    for d in range(band * step, (band + 2) * step):
        lo, hi = max(0, -d), min(len(own), len(text) - d)
        if lo < hi:
            places = lo + np.flatnonzero(text[lo + d : hi + d] == own[lo:hi])
            found.append(np.stack((places, np.full(len(places), d))))
    place, diagonal = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    order = np.argsort(place, kind="stable")
    return place[order], diagonal[order]


def _scan(index: Index, hit: np.ndarray, column):
    data, offsets = tk.buffers(column)
    for lo, hi in tk.chunks(offsets):
        codes, bounds = normal_codes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for find in (regions(index, hit, codes, bounds), whole(index, codes, bounds)):
            for r, *rest in find:
                yield lo + r, *rest


def _indexes(benchmark: DataFrame, window: int, edits: float):
    """Indexes over blocks of the benchmark of about BLOCK_CHARS characters, so
    what is sent to the executors is bounded however large the benchmark."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = build_index(sorted((r.item_id, r.text) for r in part.collect()), window, edits)
        if index:
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, edits: float = EDITS) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id,
    n_windows (found half a window apart, else 1; places of a short item), edits
    (least of a window), begin and end (code points of the normalised text that
    the windows cover).

    Null and empty texts hold nothing. Null ids of documents are kept; repeated
    rows are each reported. Items with a null or only white space are not
    searched for, repeated items once; those under LEAST_CHARS characters are
    found where a text holds them without edits between bounds of words. An empty table on
    either side gives an empty result. Further columns are not read."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    schema = "doc_id long, item_id long, n_windows long, edits int, begin long, end long"
    out = None
    for index in _indexes(benchmark, window, edits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            hit = index.table()
            for batch in batches:
                found: dict = {}
                for r, it, begin, end, e in _scan(index, hit, batch.column("_text")):
                    n, least, lo, hi = found.get((r, it), (0, e, begin, end))
                    found[r, it] = (n + 1, min(least, e), min(lo, begin), max(hi, end))
                if found:
                    ids, names = batch.column("doc_id").to_pylist(), index.ids + index.short_ids
                    rows = [(ids[r], names[it], *v) for (r, it), v in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "n_windows", "edits", "begin", "end"])

        part = source.mapInArrow(tk.tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, unchanged."""
    for index in _indexes(benchmark, window, edits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            hit = index.table()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for r, *_ in _scan(index, hit, batch.column("text")):
                    clean[r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tk.tidy(run), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
