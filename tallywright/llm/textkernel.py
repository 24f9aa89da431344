"""Vectorised text primitives over Arrow string columns.

Texts stay in Arrow's contiguous UTF-8 buffer; words, shingles and n-grams are
found and hashed with numpy over bounded chunks, so no Python object is made
for a word and memory does not depend on the length of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside letters, digits and multi-byte characters.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        step, filled = (_BASE if kind == "up" else _INVERSE), 1
        while filled < size:
            more = min(filled, size - filled)
            out[filled : filled + more] = out[:more] * np.uint64(pow(step, filled, 1 << 64))
            filled += more
        if n > 8 * CHUNK_BYTES:  # of a very long text: not kept
            return out[:n]
        have = _powers[kind] = out
    return have[:n]


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the capital letters of Latin-1, in UTF-8."""
    out = LOWER_ASCII[data]
    after = np.zeros(len(out), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    after &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[after] += 32
    return out


def release() -> None:
    """Give memory that is free inside this process back to the system, which
    shares it with the other workers of an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run``, a function over batches, that gives memory back when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of each run of bytes that aren't
    in ``between``, by default white space."""
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~between[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: prefix sums of a polynomial, then a mix."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _WEIGHTS[0])


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = LOWER_ASCII) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each white-space-separated word."""
    if fold is not None:
        data = fold[data]
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``k`` words; a row of fewer words has one
    shingle, its whole sequence; a row without words has none."""
    seeds = [np.uint64(int(_WEIGHTS[i % 4]) * (2 * i + 1) % (1 << 64)) for i in range(k)]
    n = len(hashes) - k + 1
    if n > 0:
        inside = rows[: n] == rows[k - 1 :]
        value = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            value += mix(hashes[i : n + i] ^ seeds[i]) * seeds[i]
        value, at = mix(value)[inside], rows[:n][inside]
    else:
        value, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        extra = np.empty(len(short), dtype=np.uint64)
        for j, r in enumerate(short):
            own = hashes[begin[r] : begin[r + 1]]
            extra[j] = mix(np.array([(mix(own ^ np.array(seeds[: len(own)])) * np.array(seeds[: len(own)])).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
        value, at = np.concatenate((value, extra)), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


def row_sets(value: np.ndarray, at: np.ndarray, n_rows: int) -> Iterator[np.ndarray]:
    """The sorted distinct values of each row."""
    bounds = np.searchsorted(at, np.arange(n_rows + 1))
    for r in range(n_rows):
        yield np.unique(value[bounds[r] : bounds[r + 1]])
