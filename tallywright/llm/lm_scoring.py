"""Operator 7: language-model scoring by cross-entropy difference.

Two byte-level 5-gram models share one vocabulary, the 256 bytes of UTF-8. The
background model counts all documents, the target model those that labels call
good. A document's score is the mean over its tokens of the target loss minus
the background loss (Moore and Lewis 2010); low means close to the target. Both
models are of one order and one smoothing: each n-gram is interpolated with the
one that lacks its first byte, down to single bytes, so the chances of the 256
bytes after any context sum to 1. The background is the whole corpus, no sample
of it as large as the target: its counts are to cover all documents.

Every 5-gram of every text is counted exactly, in a distributed table that has
one row for each; counts of shorter n-grams are sums of its rows. The table is
looked up in parts of about 2**PART_BITS 5-grams, as many as it takes, so the
model grows with the corpus and what is broadcast at a time does not. A part
has whole pairs of bytes before the last one; the largest is thus at least one
pair's 5-grams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import bucket, cut, small, table

PART_BITS = 21
#: Different 5-grams that a task holds before it sends their counts.
HELD = 1 << 21
#: Weight of the shorter context, in counts.
BACKOFF = 4.0
CONTEXT = 4
#: For each model: bytes with their 4 before, those 4 alone, bytes with the one before.
KINDS = ("5-grams", "4-grams", "2-grams") * 2
#: Pairs of bytes before the last one are dealt to parts by their remainder by this prime.
PRIME = 65521


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram, row) of each byte: the byte itself in the highest of 5 bytes, the
    4 before it below. Texts begin after CONTEXT zero bytes."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.zeros(len(data) + CONTEXT * (len(offsets) - 1) + 8, dtype=np.uint8)
    at = np.arange(len(data)) + CONTEXT * (rows + 1)
    padded[at] = data
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))[at - CONTEXT]
    return eight & np.uint64(0xFFFFFFFFFF), rows


def _context(grams: np.ndarray, order: int = CONTEXT + 1) -> np.ndarray:
    """n-grams of ``order`` bytes without their last byte."""
    return grams & np.uint64((1 << 8 * (order - 1)) - 1)


def _shorter(grams: np.ndarray) -> np.ndarray:
    """n-grams without their first byte."""
    return grams >> np.uint64(8)


def _dealt(five: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 5-gram, by the two bytes before its last one."""
    return (five >> np.uint64(16) & np.uint64(0xFFFF)) % np.uint64(PRIME) % np.uint64(parts)


def counted(docs: DataFrame) -> DataFrame:
    """five, n and good (occurrences in texts marked so) of every 5-gram of
    ``docs`` (text, good), exact."""

    def summed(held):
        names, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return names, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

    def sent(names, n):
        for lo in range(0, len(names), 1 << 17):
            own, count = names[lo : lo + (1 << 17)], n[lo : lo + (1 << 17)]
            five = (own >> np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(five), pa.array(count), pa.array(np.where(own & np.uint64(1), count, 0))], names=["five", "n", "good"])

    def tally(batches):
        held, size = [], 0
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = tk.buffers(batch.column("_text"))
            for lo, hi in tk.chunks(offsets, 2 << 20):
                five, rows = numbered(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.append(np.unique(five << np.uint64(1) | good[lo + rows], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*summed(held))

    parts = docs.select("good", F.col("text").alias("_text")).mapInArrow(tally, "five long, n long, good long")
    return parts.groupBy("five").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


class Counts(Sequence):
    """The distributed table of 5-grams, cut into parts of about 2**bits rows
    that keep the 5-grams of one ``_dealt`` pair together, and the counts of 2-grams. As a
    sequence it has the counts of each of KINDS, gathered on the driver."""

    def __init__(self, frame: DataFrame, bits: int):
        self.frame = frame
        self.parts = max(1, -(-frame.count() // (1 << bits)))
        self.pairs = np.zeros((2, 1 << 16), np.int64)
        for pair, n, good in frame.groupBy(F.shiftright("five", 24)).agg(F.sum("n"), F.sum("good")).collect():
            self.pairs[:, pair] = n, good

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(5-grams, their counts in all texts and in good ones) of one part."""
        own = self.frame if self.parts == 1 else self.frame.where((F.shiftright("five", 16).bitwiseAND(0xFFFF) % PRIME) % self.parts == i)
        found = own.select("five", "n", "good").toArrow()
        five, n, good = (found.column(c).to_numpy() for c in ("five", "n", "good"))
        return five.astype(np.uint64), np.stack((n, good))

    def __len__(self) -> int:
        return len(KINDS)

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(KINDS):
            raise IndexError(i)
        model, kind = divmod(i, 3)
        if KINDS[kind] == "2-grams":
            return self.pairs[model]
        found = [self.part(p) for p in range(self.parts)]
        five, n = np.concatenate([x for x, _ in found]), np.concatenate([n[model] for _, n in found])
        return n if KINDS[kind] == "5-grams" else np.bincount(np.unique(_context(five), return_inverse=True)[1], n).astype(np.int64)


def gather(docs: DataFrame, bits: int) -> Counts:
    """The counts of ``docs`` (text, good), exact, to be looked up in parts of
    about 2**bits 5-grams. They stay distributed; the driver gets those of 2-grams."""
    return Counts(cut(counted(docs)), bits)


class Names:
    """Places of numbers in a set of them, which is sorted by a hash without collisions."""

    def __init__(self, names: np.ndarray):
        mixed = tk.mix(names)
        self.order = np.argsort(mixed)
        self.mixed = np.append(mixed[self.order], np.uint64(2**64 - 1))
        bits = max(1, len(names).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.mixed[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in sorted order, whether it is there) of each number."""
        mixed = tk.mix(names)
        at = self.first[(mixed >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.mixed[at] < mixed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.mixed[at[behind]] < mixed[behind]]
        return at, (self.mixed[at] == mixed) & (at < len(self.order))


class Order:
    """Chances of the n-grams of one order in a part, and how often each of
    their contexts occurs, which is all that an n-gram not in it needs."""

    def __init__(self, order: int, names: np.ndarray, n: np.ndarray, lower: np.ndarray):
        contexts, inverse = np.unique(_context(names, order), return_inverse=True)
        total = np.stack([np.bincount(inverse, x, minlength=len(contexts)) for x in n])
        #: In the order of names, for the next order.
        self.chance = (n + BACKOFF * lower) / (total[:, inverse] + BACKOFF)
        self.names, self.contexts = Names(names), Names(contexts)
        self.sorted, self.total = self.chance[:, self.names.order], total[:, self.contexts.order]

    def slim(self) -> None:
        """Leave out what only building needs."""
        del self.chance
        self.names.order, self.contexts.order = (np.empty(len(x.order), np.bool_) for x in (self.names, self.contexts))


class Part:
    """Chances of the 3-, 4- and 5-grams of one part, by the background model
    and by the target model; those of 2-grams are ``short``."""

    def __init__(self, five: np.ndarray, n: np.ndarray, short: np.ndarray):
        self.short, self.orders = short, {}
        below, lower = None, None
        for order in range(3, CONTEXT + 2):
            names, inverse = np.unique(five >> np.uint64(8 * (CONTEXT + 1 - order)), return_inverse=True)
            counts = np.stack([np.bincount(inverse, x, minlength=len(names)) for x in n])
            shorter = _shorter(names)
            chance = short[:, shorter.astype(np.int64)] if below is None else lower[:, np.searchsorted(below, shorter)]
            self.orders[order] = Order(order, names, counts, chance)
            below, lower = names, self.orders[order].chance
        for own in self.orders.values():
            own.slim()

    def chances(self, grams: np.ndarray, order: int = CONTEXT + 1) -> np.ndarray:
        """Probability of the last byte of each n-gram after those before it."""
        if order == 2:
            return self.short[:, grams.astype(np.int64)]
        own = self.orders[order]
        at, there = own.names.find(grams)
        if there.all():
            return own.sorted[:, at]
        out = np.empty((2, len(grams)))
        out[:, there] = own.sorted[:, at[there]]
        new = grams[~there]
        at, known = own.contexts.find(_context(new, order))
        total = np.zeros((2, len(new)))
        total[:, known] = own.total[:, at[known]]
        out[:, ~there] = BACKOFF * self.chances(_shorter(new), order - 1) / (total + BACKOFF)
        return out

    def losses(self, five: np.ndarray) -> np.ndarray:
        """Minus log-probability of each byte after those before it, by the
        background model and by the target model."""
        return -np.log(self.chances(five))


@dataclass
class Models:
    bits: int
    tables: Counts

    @property
    def short(self) -> np.ndarray:
        """Probability of each byte after the one before it, by each model."""
        square = self.tables.pairs.reshape(2, 256, 256).astype(np.float64)  # row: the byte itself, column: the one before
        alone = (square.sum(axis=2) + 1) / (square.sum(axis=(1, 2))[:, None] + 256)
        return ((square + BACKOFF * alone[:, :, None]) / (square.sum(axis=1)[:, None, :] + BACKOFF)).reshape(2, -1)

    def part(self, i: int) -> Part:
        return Part(*self.tables.part(i), self.short)


def fit(docs: DataFrame, good: DataFrame) -> Models:
    """Models from all of ``docs`` and, as target, those with an id in ``good`` (doc_id)."""
    ids = small(good.where("doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True)))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    return Models(PART_BITS, gather(marked, PART_BITS))


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (their mean
    difference per token) of every row, whole texts. A token is a byte.
    Null and empty texts have none, null losses and a null score. Repeated rows and null
    ids are scored each; an empty table gives an empty result."""
    parts = models.tables.parts
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), F.lit(0).cast("long").alias("_row"))
    if parts > 1:
        source = cut(source.withColumn("_row", F.monotonically_increasing_id()))

    def sums(i: int) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(models.part(i))

        def run(batches):
            part = shared.value
            for batch in batches:
                data, offsets = tk.buffers(batch.column("_text"))
                total = np.zeros((2, batch.num_rows))
                for lo, hi in tk.chunks(offsets):
                    five, rows = numbered(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if parts > 1:
                        own = _dealt(five, parts) == i
                        five, rows = five[own], rows[own]
                    for of_model, loss in zip(total, part.losses(five), strict=True):
                        of_model[lo:hi] = np.bincount(rows, loss, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total[1]), pa.array(total[0])], names=["_row", "doc_id", "n_tokens", "target", "background"])

        return source.mapInArrow(run, "_row long, doc_id long, n_tokens long, target double, background double")

    out = sums(0)
    if parts > 1:
        for i in range(1, parts):
            out = out.unionByName(sums(i))
        out = out.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("target").alias("target"), F.sum("background").alias("background"))
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.expr(x) / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", mean("target").alias("loss_target"), mean("background").alias("loss_background"), mean("target - background").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels call of good quality, but for one fifth of the ids."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 5) == 0
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out)
    return score(docs, fit(docs, good)).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
