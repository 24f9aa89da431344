"""Operator 12: phrases that stick together, found in two passes over the texts.

1. Cells: every n-gram (1 to ``LONGEST`` words, by language) falls into one of
   ``cells`` numbered cells by its hash. They are far more than the n-grams, and no
   task holds them: tasks send the numbers of their n-grams' cells in order, in
   parts of equal ranges of numbers, and a part is merged at a time. An n-gram whose
   cell is met fewer than ``least`` times can't be frequent.
2. Exact counts: the texts are read again, and only n-grams whose cells are met
   ``least`` times, and those of all shorter n-grams inside them, are counted,
   by their words, with Spark's aggregate. Those that turn out to be rarer are dropped,
   so nothing frequent is lost and no count is an estimate.

Scores, the least cut of a phrase, and phrases inside longer ones follow by joins.

A task sends a number at most ``least`` times from each run of numbers that it sorts:
that many are enough. What the second pass is told grows with the frequent phrases, not
with the cells: numbers are cut to their first bits, some 8 to 16 cells for each cell that
is left. With more distinct n-grams than cells fewer are ruled out and the second pass counts
more of them; results are the same.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as tk
from .runtime import cut, partitions, table

LONGEST = 4
LEAST = 30
TOP = 2000
CELLS = 1 << 36
#: Fewest cells; most cells that the second pass is told of, a bit for each.
FEWEST, MOST = 1 << 17, 1 << 30
#: Cell numbers that a task sorts and sends at once.
RUN = 1 << 22
#: Text bytes that a task counts at once; a longer text is counted in pieces.
CHUNK_BYTES = 4 << 20
#: Most words and languages that a task remembers; then it begins anew.
VOCABULARY = 1 << 20
#: Over how many lanes a part of one, two or three words is dealt: many phrases begin or end with one frequent word.
LANES = (16, 4, 1)
LOTS = 128

_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: A byte that no UTF-8 text holds stands between pieces.
BREAK = b"\xff"
_FOLD = bytearray(range(256))
_FOLD[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = BREAK[0]
_FOLD[9] = 32
FOLD = bytes(_FOLD)


class Numbers(dict):
    """Numbers for byte strings in order of first sight; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.names, self.hashes = [BREAK], array("Q", [0])

    def __missing__(self, name: bytes) -> int:
        number = self[name] = len(self.names)
        self.names.append(name)
        self.hashes.append(xxhash.xxh64_intdigest(name))
        return number


def pieces(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``text`` (folded) in slices of about ``size`` bytes that end at a space or a
    break; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        end = at + size
        ends = [p for p in (text.rfind(b" ", at, end), text.rfind(BREAK, at, end)) if p >= 0]
        if not ends:
            ends = [min([p for p in (text.find(b" ", end), text.find(BREAK, end)) if p >= 0], default=len(text) - 1)]
        yield text[at : max(ends) + 1]
        at = max(ends) + 1
    yield text[at:]


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, count, rank by place) of the distinct values, which aren't
    negative. Where value and place fit into 63 bits together, one sort of plain
    integers does; otherwise numpy's own way."""
    bits = max(len(values) - 1, 1).bit_length()
    if int(values.max()).bit_length() + bits > 63:
        _, first, rank, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        return first, counts, rank
    packed = np.sort((values << bits) | np.arange(len(values)))
    place, value = packed & ((1 << bits) - 1), packed >> bits
    new = np.ones(len(values), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    at = np.flatnonzero(new)
    rank = np.empty(len(values), dtype=np.int64)
    rank[place] = np.cumsum(new) - 1
    return place[at], np.diff(np.append(at, len(values))), rank


class Chunk:
    """Words of several texts: ``ids`` by place (0: break) and ``langs`` by place.
    The first ``known`` places were counted before, in the chunk of the same text
    just before this one: n-grams that end there don't count again."""

    def __init__(self, ids: np.ndarray, langs: np.ndarray, known: int):
        self.ids, self.langs, self.known = ids, langs, known

    def places(self, longest: int, alive: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(n, places where an n-gram begins). Where ``alive`` says no to an n-gram,
        it and longer ones that hold it are left out."""
        starts = np.flatnonzero(self.ids)
        for n in range(1, longest + 1):
            if n > 1:  # starts that have one more word in their piece
                more = starts + n - 1 < len(self.ids)
                more[more] = self.ids[starts[more] + n - 1] != 0
                if alive is not None:
                    more[more] = kept[starts[more] + 1]  # noqa: F821
                starts = starts[more]
            if alive is not None:
                starts = starts[alive(n, starts)]
                kept = np.zeros(len(self.ids), dtype=bool)
                kept[starts] = True
            if not len(starts):
                return
            yield n, starts

    def grams(self, longest: int, words: Numbers, alive: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first place, count) of the distinct n-grams of each language. Codes
        are dense ranks of (code of the first n-1 words, last word): exact."""
        code = self.langs.copy()
        for n, starts in self.places(longest, alive):
            first, counts, rank = grouped(code[starts] * len(words.names) + self.ids[starts + n - 1])
            code[starts] = rank
            old = starts + n - 1 < self.known
            if old[0]:
                counts = counts - np.bincount(rank[old], minlength=len(counts))
            yield n, starts[first], counts


def word_chunks(batches, words: Numbers, languages: Numbers, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of Arrow batches of (text as bytes, language). Between chunks the
    numbers begin anew if there are too many."""
    tokens: list[bytes] = []
    marks: list[tuple[int, bytes]] = []
    size = 0

    def chunk(known: int) -> Chunk:
        ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        bounds = np.array([m for m, _ in marks] + [len(tokens)])
        langs = np.repeat(np.fromiter((languages[x] for _, x in marks), np.int64, len(marks)), np.diff(bounds))
        return Chunk(ids, langs, known)

    def renew() -> None:
        for numbers in (words, languages):
            if len(numbers.names) > VOCABULARY:
                numbers.clear()
                numbers.__init__()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            folded, lang = text.as_py().translate(FOLD), lang.as_py().encode()
            known: list[bytes] = []
            for part in pieces(folded, chunk_bytes):
                if size and size + len(part) > chunk_bytes:
                    yield chunk(0)
                    tokens, marks, size = [], [], 0
                    renew()
                marks.append((len(tokens), lang))
                tokens += [*known, *part.replace(BREAK, b" \xff ").split()]
                size += len(part)
                if len(folded) > chunk_bytes:  # a slice of a long text: the next one goes on from its last words
                    last = tokens[-(LONGEST - 1) :]
                    yield chunk(len(known))
                    known, tokens, marks, size = last, [], [], 0
                    renew()
                else:
                    tokens.append(BREAK)
    if tokens:
        yield chunk(0)


class Cells:
    """Cell of the n-gram at each place, by its words and language: the first ``bits``
    bits of a hash that goes on from the n-gram one word shorter at that place, so
    lengths are asked for one after another."""

    def __init__(self, chunk: Chunk, words: Numbers, languages: Numbers, bits: int):
        self.word = np.array(words.hashes, dtype=np.uint64)[chunk.ids]
        self.value = np.array(languages.hashes, dtype=np.uint64)[chunk.langs] * _SEEDS[3]
        self.shift = np.uint64(64 - bits)

    def __call__(self, n: int, places: np.ndarray) -> np.ndarray:
        value = tk.mix((self.value[places] ^ self.word[places + n - 1]) * _SEEDS[0])
        self.value[places] = value
        return value >> self.shift


def parts_of(cells: int, tasks: int) -> int:
    """Into how many parts of equal ranges cells are dealt: two or more for each task,
    none of over 2^32 cells."""
    bits = cells.bit_length() - 1
    return 1 << max(bits - 32, min((2 * tasks - 1).bit_length(), 14, bits - 16))


def packed(numbers: np.ndarray, cells: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(first cell of a part, groups, bytes) of sorted cell numbers. Of many numbers
    the last 16 bits are kept, and before them how many each group of 2^16 cells
    has; of few (0 groups) 32 bits, from the part's first cell."""
    width = cells // parts
    bounds = np.searchsorted(numbers, np.arange(parts + 1, dtype=np.uint64) * np.uint64(width))
    groups, sizes = width >> 16, None
    if len(numbers) > 2 * parts * groups:
        sizes = np.bincount((numbers >> np.uint64(16)).astype(np.int64), minlength=parts * groups)
        if sizes.max() >= 1 << 16:
            sizes = None
    for part in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        some = numbers[bounds[part] : bounds[part + 1]]
        if sizes is None:
            yield part * width, 0, (some - np.uint64(part * width)).astype(np.uint32).tobytes()
        else:
            yield part * width, groups, sizes[part * groups : (part + 1) * groups].astype(np.uint16).tobytes() + some.astype(np.uint16).tobytes()


def unpacked(groups: int, data: pa.Buffer) -> np.ndarray:
    """Cell numbers from the part's first cell."""
    if not groups:
        return np.frombuffer(data, dtype=np.uint32)
    halves = np.frombuffer(data, dtype=np.uint16)
    return np.repeat(np.arange(groups, dtype=np.uint32) << np.uint32(16), halves[:groups]) | halves[groups:]


def packed_set(numbers: np.ndarray) -> bytes:
    """Distinct cell numbers in order, as differences."""
    steps = np.diff(numbers, prepend=np.zeros(1, numbers.dtype))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if steps[1:].max(initial=0) <= np.iinfo(k).max)
    return zlib.compress(bytes([np.dtype(kind).itemsize]) + int(steps[0]).to_bytes(8, "little") + steps[1:].astype(kind).tobytes(), 1)


def unpacked_set(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    steps = np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=9)
    return np.cumsum(np.append(np.uint64(int.from_bytes(raw[1:9], "little")), steps.astype(np.uint64)), dtype=np.uint64)


def bitmap(sets: Iterator[bytes], cells: int) -> np.ndarray:
    """A bit for each of ``cells``, set where a set has its number."""
    bits = np.zeros(cells // 8, dtype=np.uint8)
    for data in sets:
        numbers = unpacked_set(data)
        byte = (numbers >> np.uint64(3)).astype(np.int64)
        first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        bits[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (numbers & np.uint64(7)).astype(np.uint8), first)
    return bits


# The next two work on cells held in memory; only a test of counting that stops uses them now.
def _count(cells: np.ndarray, at: np.ndarray, counts: np.ndarray, least: int) -> None:
    """cells[at] += counts, stopping at ``least``; places may repeat."""
    if not len(at):
        return
    packed = np.sort(at * (least + 1) + counts)
    place = packed // (least + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    distinct, total = place[first], np.add.reduceat(packed % (least + 1), first)
    cells[distinct] = np.minimum(cells[distinct] + total, least)


def _add(cells: np.ndarray, more: np.ndarray, least: int) -> None:
    """cells += more, stopping at ``least``, in place."""
    total = cells.astype(np.int64) + more
    np.minimum(total, least, out=total)
    cells[:] = total


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def sketches(docs: DataFrame, text_col: str, lang_col: str, least: int, cells: int) -> DataFrame:
    """(block, groups, cells) as ``packed``, block being a part's first cell: the cells
    of all n-grams, each as often as it is met but at most ``least`` times a run. And
    (-1 - k, 0, language, words): how many words of a language the task saw."""
    parts, bits, most = parts_of(cells, partitions(docs.sparkSession)), cells.bit_length() - 1, RUN
    names = ["block", "groups", "cells", "words"]

    def sent(numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers.sort()
        keep = np.ones(len(numbers), dtype=bool)
        keep[least:] = numbers[least:] != numbers[:-least]
        found = list(packed(numbers[keep], cells, parts))
        if found:
            block, groups, data = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(groups, pa.int64()), pa.array(data, pa.binary()), pa.array([0] * len(block), pa.int64())], names=names)

    def run(batches):
        words, languages, totals = Numbers(), Numbers(), {}
        numbers, size = np.empty(most, dtype=np.uint64), 0
        for chunk in word_chunks(batches, words, languages):
            cell_of = Cells(chunk, words, languages, bits)
            for n, places in chunk.places(LONGEST):
                new = cell_of(n, places)[np.searchsorted(places, chunk.known - n + 1) :]
                while len(new):
                    some, new = new[: most - size], new[most - size :]
                    numbers[size : size + len(some)] = some
                    size += len(some)
                    if size == most:
                        yield from sent(numbers)
                        size = 0
            for lang, count in zip(*np.unique(chunk.langs[chunk.known :][chunk.ids[chunk.known :] > 0], return_counts=True), strict=True):
                name = languages.names[lang]
                totals[name] = totals.get(name, 0) + int(count)
        yield from sent(numbers[:size])
        if totals:
            lots = [-1 - zlib.crc32(name) % LOTS for name in totals]
            yield pa.RecordBatch.from_arrays([pa.array(lots, pa.int64()), pa.array([0] * len(lots), pa.int64()), pa.array(list(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], names=names)

    return _texts(docs, text_col, lang_col).mapInArrow(tk.tidy(run), "block long, groups long, cells binary, words long")


def merged(parts: DataFrame, least: int, tasks: int) -> DataFrame:
    """(block, reached, size, words): for each part the set of cells that are met
    ``least`` times or more, with its size; the words of languages as they are. Parts
    are dealt over ``tasks``; a task holds the numbers of one part at a time."""
    names = ["block", "reached", "size", "words"]

    def row(block: int, data: bytes, size: int, words: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([size], pa.int64()), pa.array([words], pa.int64())], names=names)

    def frequent(block: int, runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(runs)
        numbers.sort()
        often = numbers[least - 1 :][numbers[least - 1 :] == numbers[: max(0, len(numbers) - least + 1)]]
        if len(often):
            often = often[np.append(True, often[1:] != often[:-1])]
            yield row(block, packed_set(often.astype(np.uint64) + np.uint64(block)), len(often), 0)

    def run(batches):
        block, runs = -1, []
        for batch in batches:
            for number, groups, data, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if number < 0:
                    yield row(number, data.as_py(), 0, words)
                    continue
                if number != block and runs:
                    yield from frequent(block, runs)
                    runs = []
                block = number
                runs.append(unpacked(groups, data.as_buffer()))
        if runs:
            yield from frequent(block, runs)

    dealt = parts.repartition(tasks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(tk.tidy(run), "block long, reached binary, size long, words long")


def coarser(found: DataFrame, cells: int, told: int) -> DataFrame:
    """(block, reached) of ``merged`` with numbers of ``told`` cells instead of ``cells``."""
    less = np.uint64((cells // told).bit_length() - 1)

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = unpacked_set(data.as_buffer()) >> less
                numbers = numbers[np.append(True, numbers[1:] != numbers[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([block >> int(less)], pa.int64()), pa.array([packed_set(numbers)], pa.binary())], names=["block", "reached"])

    return found.where("block >= 0").select("block", "reached").mapInArrow(tk.tidy(run), "block long, reached binary")


def survivors(docs: DataFrame, text_col: str, lang_col: str, reached, cells: int) -> DataFrame:
    """(lang, phrase, f) of the n-grams of each chunk whose cells, and those of the
    n-grams inside them, are all in ``reached``: a broadcast of sets of numbers of
    ``cells`` cells."""

    def run(batches):
        words, languages = Numbers(), Numbers()
        bits = bitmap((data for block, data in reached.value if block >= 0), cells)
        for chunk in word_chunks(batches, words, languages):
            cell_of = Cells(chunk, words, languages, cells.bit_length() - 1)

            def alive(n: int, places: np.ndarray, cell_of=cell_of) -> np.ndarray:
                cell = cell_of(n, places).astype(np.int64)
                return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

            names = None
            for n, places, counts in chunk.grams(LONGEST, words, alive):
                places, counts = places[counts > 0], counts[counts > 0]
                if not len(places):
                    continue
                if names is None:
                    names, langs = pa.array(words.names, pa.binary()), pa.array(languages.names, pa.binary())
                text = pc.binary_join_element_wise(*(names.take(pa.array(chunk.ids[places + i])) for i in range(n)), pa.scalar(b" ", pa.binary()))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(chunk.langs[places])), text, pa.array(counts)], names=["lang", "phrase", "f"])

    found = _texts(docs, text_col, lang_col).mapInArrow(tk.tidy(run), "lang binary, phrase binary, f long")
    return found.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f), (lang, n)): the exact count of every phrase of 1 to
    4 words that occurs at least ``least`` times in its language, and all word
    occurrences of each language. Both are written to the checkpoint folder.

    The set of cells that are met often enough is the only thing that passes through
    the driver, as packed differences: 8 to 16 cells for each, ``MOST`` at most."""
    if cells & (cells - 1) or not FEWEST <= cells <= 1 << 46:
        raise ValueError(f"cells must be a power of two from {FEWEST} to 2^46")
    spark, least = docs.sparkSession, max(least, 1)  # what is counted occurs
    found = cut(merged(sketches(docs, text_col, lang_col, least, cells), least, partitions(spark)))
    words = found.where("block < 0").groupBy(F.col("reached").cast("string").alias("lang")).agg(F.sum("words").alias("n"))
    told = min(cells, MOST, max(FEWEST, 1 << (8 * (found.agg(F.sum("size")).first()[0] or 0)).bit_length()))
    reached = spark.sparkContext.broadcast([(r.block, bytes(r.reached)) for r in coarser(found, cells, told).collect()])
    exact = survivors(docs, text_col, lang_col, reached, told).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(exact.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f")), words


def wide(count: Column) -> Column:
    return count.cast("decimal(20,0)")


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exact beyond 64 bits."""
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r)).cast("long")


def _words(phrase: str, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, k): each phrase of two words or more by
    its lowest-scoring cut, of equal scores the first. Parts meet their counts
    dealt over salts, as many phrases begin or end with one frequent word."""
    lanes = lambda size: F.element_at(F.array(*map(F.lit, LANES)), size)
    long = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        F.inline(F.array(
            F.struct(F.lit("l").alias("side"), _words("phrase", F.lit(1), F.col("k")).alias("part"), F.col("k").alias("words")),
            F.struct(F.lit("r").alias("side"), _words("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("part"), (F.col("size") - F.col("k")).alias("words")),
        )),
    )
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("phrase"), lanes(F.col("words"))).cast("int")).drop("words")
    known = counts.where(F.col("size") < LONGEST).select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), lanes(F.col("size")) - 1)).alias("salt"))
    met = parts.join(known, ["lang", "part", "salt"])
    side = lambda name, k: F.max(F.when((F.col("side") == name) & (F.col("k") == k), F.col("f")))
    sides = met.groupBy("lang", "phrase", "a").agg(*(side(name, k).alias(f"{name}{k}") for k in range(1, LONGEST) for name in ("l", "r")))
    cut_at = lambda k: F.when(
        F.col(f"l{k}").isNotNull(),
        F.struct(score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")),
    )
    least = sides.select("lang", "phrase", "a", F.least(*(cut_at(k) for k in range(1, LONGEST))).alias("m"))
    return least.select("lang", "phrase", "a", "m.l", "m.r", "m.score", "m.k")


def subsumed(counts: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase) that lie inside a longer phrase which has at least ``percent``
    in a hundred of their occurrences."""
    long = counts.where("size >= 3").select("lang", "phrase", "size", "f")
    sizes = long.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("at"))
    most = inner.groupBy("lang", _words("phrase", F.col("at"), F.col("n")).alias("phrase")).agg(F.max("f").alias("longer"))
    return counts.join(most, ["lang", "phrase"]).where(wide(F.lit(100)) * wide(F.col("longer")) >= wide(F.lit(percent)) * wide(F.col("f"))).select("lang", "phrase")


def ranked(phrases: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: first of each of many lots of a
    language, then of what those leave."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    lots = phrases.withColumn("lot", F.pmod(F.xxhash64("phrase", "a"), F.lit(LOTS)).cast("int"))
    first = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    final = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return final.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """Best phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r,
    n, score.

    A-Z is lower-cased; texts are cut at any of ``.,;:!?`` and line ends into
    pieces, those at spaces and tabs into words. A null text counts as empty, a null
    language as ``und``; every row counts, repeated ones too. Phrases of equal score
    and count are ordered by their UTF-8 bytes. Texts of any length are counted
    whole; a phrase across the slices of a long text counts once. An empty table
    gives no row. Other columns are ignored, whatever their names.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least, cells)
    return ranked(scored(counts).join(subsumed(counts), ["lang", "phrase"], "left_anti"), words, top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
starts AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + 3])) AS g FROM p),
grams AS (SELECT lang, g[1:k] AS g, k FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= len(g)),
f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, any_value(k) AS k, count(*) AS f FROM grams GROUP BY 1, 2 HAVING count(*) >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j, array_to_string(g[1:j], ' ') AS x, array_to_string(g[j + 1:k], ' ') AS y
  FROM f, (SELECT unnest([1, 2, 3]) AS j) WHERE k > j),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS MATERIALIZED (
  SELECT c.lang, array_to_string(c.g[i:i + m - 1], ' ') AS phrase, max(c.f) AS longer
  FROM f c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY 1, 2),
left_over AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE i.longer IS NULL OR CAST(100 AS HUGEINT) * i.longer < CAST(80 AS HUGEINT) * b.a)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM left_over m JOIN n ON n.lang = m.lang QUALIFY rank <= 2000
"""
