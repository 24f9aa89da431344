"""Operator 2: token ids packed into matrix rows by best-fit decreasing.

Each task tokenises its documents and packs them window by window (bounded by
tokens, so memory is too). Of a window's segments the longest come first; each
goes to the open row with the least room that still holds it, found in a
segment tree over room sizes. Documents longer than a row are split into full
rows and a rest, without loss. A row holds its ids, cumulative segment lengths,
the places where positions restart, and which part of which document it has (``row`` numbers the documents by task).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table
from .wordpieces import END_OF_TEXT, byte_encoder

CAPACITY, WINDOW_TOKENS = 2048, 2_000_000
SCHEMA = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, segments array<struct<doc_id:long,row:long,part:int,offset:long,length:int>>"
ARROW = pa.schema([
    ("pack_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
    ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("offset", pa.int64()), ("length", pa.int32())]))),
])


class Rooms:
    """Open rows by the room they have left; node i of the tree tells whether
    any room below it has a row."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.width
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove a row with the least room of ``size`` at least: (room, row)."""
        i = size + self.width
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = False
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = False
                i >>= 1
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``sizes``: best fit, longest first, ties by index."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i]) if sizes[i] < capacity else None
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


def pack_window(docs: list[tuple], capacity: int, pad: int, dtype: str):
    """Packed rows (without pack_id) of (doc_id, row, ids) triples."""
    parts = [((own, row), part, at, ids[at : at + capacity]) for own, row, ids in docs for part, at in enumerate(range(0, len(ids), capacity))]
    for row in best_fit([len(p[3]) for p in parts], capacity):
        own = [parts[i] for i in row]
        ends = np.cumsum([len(p[3]) for p in own])
        line = np.full(capacity, pad, dtype=dtype)
        line[: ends[-1]] = np.concatenate([p[3] for p in own])
        cumulative = [0, *ends.tolist()]
        yield line.tobytes(), int(ends[-1]), cumulative, cumulative[:-1], [{"doc_id": p[0][0], "row": p[0][1], "part": p[1], "offset": p[2], "length": len(p[3])} for p in own]


def packed(docs: DataFrame, capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, tokenizer: str | None = None, end: int = END_OF_TEXT) -> DataFrame:
    """Matrix rows of all documents (doc_id, text); one ``end`` id closes each
    document and fills up rows. ids are little-endian, two bytes each if the
    vocabulary allows, else four.

    Null counts as empty; an empty text is its ``end`` id. Repeated rows are
    packed each, null ids too. A row never mixes tasks or windows, so it
    depends on how the input is split, but not on anything else. An empty table
    gives no row; further columns are not read."""

    def run(batches):
        encoder = byte_encoder(tokenizer)
        dtype = "<u2" if max(encoder.size, end + 1) <= 1 << 16 else "<i4"
        number = number_of_row = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        size = 0

        def flush():
            nonlocal number
            rows = []
            for row in pack_window(waiting, capacity, end, dtype):
                rows.append((number, *row))
                number += 1
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            waiting.clear()

        for batch in batches:
            for own, text in zip(batch.column("doc_id"), batch.column("_text"), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), end).astype(dtype)
                waiting.append((own.as_py(), number_of_row, ids))
                number_of_row += 1
                size += len(ids)
                if size >= window_tokens:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def positions(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, 0 in the filling."""
    out = np.zeros(capacity, dtype=np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def unpacked(rows: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids) again, one row for each that was packed: the parts of a
    document are put together by its row, so repeated and null ids stay apart.
    ``width`` is the size of an id in bytes."""
    part = rows.select("ids", F.posexplode("segments").alias("i", "s"), "cu_seqlens")
    cut = part.select("s.doc_id", "s.row", "s.part", F.substring("ids", F.element_at("cu_seqlens", F.col("i") + 1) * width + 1, F.col("s.length") * width).alias("piece"))
    joined = cut.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"))
    return joined.select("doc_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
