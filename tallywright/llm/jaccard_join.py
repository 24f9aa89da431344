"""Operator 8: n-gram Jaccard join by vertical partitioning.

All shingles get one global order: by a corpus-wide count (rare ones first),
then by hash. Pivots cut that order into fragments of about equal mass. The
overlap of two documents is counted in each fragment on its own and the partial
counts of a pair are summed; links are decided on the exact sums.

Which pairs are counted:

* documents with equal sets are one class, represented by its smallest id;
* hubs: each representative is paired with the most central member of four
  min-hash buckets, a number of pairs linear in the documents. The links found
  make components;
* the rest, without loss: two sets of this similarity share a shingle among the
  first ``n - ceil(0.85 n) + 1`` of either in the global order. Only posting
  lists that hold two components matter, since a link inside a component changes
  nothing, so a large group of near copies costs no quadratic work. Of those
  lists, first each member's most similar one of another component is counted
  (a linear number of pairs, which joins what hubs left apart), then all pairs
  that are still between components;
* odd sketches prove of most pairs that too many shingles differ; only the
  others are counted.

Posting lists are cut into bands of set size and blocks of BLOCK members, so
that a list of any length is spread over tasks of bounded memory.

Sets are compared by 64-bit hashes of their shingles: two sets of n shingles are
misjudged by a collision with a chance of about n^2 / 2^64.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected
from .runtime import cut, partitions, small, table

WORDS, PERCENT, FRAGMENTS = 4, 85, 4
SKETCH_BITS, BLOCK_BITS, LEVELS = 21, 15, 64
HUBS = 4
#: Bits of the sketch that goes with an entry of a posting list, and most entries of a block.
FOLD_BITS, BLOCK = 512, 2048
#: Most entries that go to the JVM at once.
BATCH_ROWS = 50_000
#: Rounds of most similar partners before all pairs that are left.
NEAREST_ROUNDS = 2


def _sets(batch, words: int):
    """Shingle hashes and rows of each chunk of a batch: (first row, rows, hash, row)."""
    data, offsets = tk.buffers(batch.column("_text"))
    for lo, hi in tk.chunks(offsets):
        h, rows = tk.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        value, at = tk.shingles(h, rows, hi - lo, words)
        yield lo, hi - lo, value, at


def count_sketch(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Occurrences of all shingles of all texts, by the first SKETCH_BITS of
    their hash: 2**SKETCH_BITS numbers for any size of the corpus."""
    shift, width = np.uint64(64 - SKETCH_BITS), 1 << BLOCK_BITS

    def tally(batches):
        total, waiting, n = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for batch in batches:
            for _, _, value, _ in _sets(batch, words):
                waiting.append((value >> shift).astype(np.int32))
                n += len(value)
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        yield from _blocks(total)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, dtype, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(data, dtype=dtype).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for block, part in sums.items():
            total[block * width : (block + 1) * width] = part
        yield from _blocks(total)

    def _blocks(total):
        for block in range(len(total) // width):
            part = total[block * width : (block + 1) * width]
            if part.any():
                dtype = next(t for t in ("uint8", "uint16", "uint32", "int64") if part.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "dtype": [dtype], "data": pa.array([part.astype(dtype).tobytes()], pa.binary())})

    schema = "block int, dtype string, data binary"
    parts = docs.select(F.col("text").alias("_text")).mapInArrow(tk.tidy(tally), schema)
    merged = parts.repartition(min(64, partitions(docs.sparkSession)), "block").mapInArrow(tk.tidy(merge), schema)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, dtype, data in merged.collect():  # at most 2**(SKETCH_BITS - BLOCK_BITS) rows
        total[block * width : (block + 1) * width] += np.frombuffer(bytes(data), dtype=dtype).astype(np.int64)
    return total


class GlobalOrder:
    """Sorts shingle hashes by level (of their count), then by hash, and cuts
    that order at pivots."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        mean = max(1.0, float(counts.mean()))
        steps = np.floor(3 * np.log2(np.maximum(counts, 1) / mean))
        self.levels = steps.clip(0, LEVELS - 1).astype(np.uint8)
        mass = np.cumsum(np.bincount(self.levels, weights=counts, minlength=LEVELS))
        self.pivots: list[tuple[int, int]] = []
        for i in range(1, fragments):
            goal = mass[-1] * i / fragments
            level = int(np.searchsorted(mass, goal))
            before = mass[level - 1] if level else 0.0
            part = (goal - before) / max(mass[level] - before, 1.0)
            self.pivots.append((level, int(part * ((1 << 64) - 1))))

    def _levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]

    def commonness(self, own: np.ndarray) -> float:
        """Mean level of a set: each edit of a copied text puts rare shingles for common ones."""
        return float(self._levels(own).mean()) if len(own) else 0.0

    def first(self, own: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a set, given sorted by hash."""
        return own[np.argsort(self._levels(own), kind="stable")[:n]]

    def fragments(self, own: np.ndarray) -> list[np.ndarray]:
        """The parts of a set between the pivots, each sorted by hash."""
        level, at = self._levels(own), np.zeros(len(own), dtype=np.int64)
        for pivot, value in self.pivots:
            at += (level > pivot) | ((level == pivot) & (own >= np.uint64(value)))
        return [own[at == f] for f in range(len(self.pivots) + 1)]


def odd_bits(own: np.ndarray, bits: int) -> bytes:
    """Bit i tells whether an odd number of members fall to place i."""
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity(own: np.ndarray) -> bytes:
    """Odd sketch of a set with at least two places for a member."""
    return odd_bits(own, max(64, 1 << int(2 * len(own)).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """At most the size of the symmetric difference of two sets, from their odd
    sketches: each differing place has a member that only one set has."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def screened(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` without those whose odd sketches prove that too many members
    differ. Loses no link: the sketches give a lower bound."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            most = (na + nb) * (100 - percent) // (100 + percent)
            apart = np.array([differing(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], dtype=np.int64)
            yield batch.filter(pa.array(apart <= most)).select(["a", "b", "na", "nb"])

    nodes = nodes.select("id", "parity").join(members(pairs), "id", "left_semi")
    both = pairs.join(nodes.select(F.col("id").alias("a"), F.col("parity").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("parity").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(tk.tidy(run), "a long, b long, na long, nb long")


def signatures(docs: DataFrame, shared, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, set size, commonness, digest of the set, hub keys, prefix and sketches of every row."""

    def run(batches):
        order = shared.value
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "common", "digest", "hubs", "prefix", "parity", "fold")}
            for _, n, value, at in _sets(batch, words):
                bins = np.full(n * 2 * HUBS, np.iinfo(np.uint64).max, dtype=np.uint64)
                turned = tk.mix(value + np.uint64(0x632BE59BD9B4E019))
                np.minimum.at(bins, at * (2 * HUBS) + (turned & np.uint64(2 * HUBS - 1)).astype(np.int64), turned)
                bins = bins.reshape(n, 2 * HUBS)
                keys = tk.mix(bins[:, ::2] + tk.mix(bins[:, 1::2]) + np.arange(HUBS, dtype=np.uint64))
                out["hubs"] += list(keys.view(np.int64))
                for own in tk.row_sets(value, at, n):
                    length = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                    out["n"].append(len(own))
                    out["common"].append(order.commonness(own))
                    out["digest"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    out["prefix"].append(order.first(own, length).tobytes())
                    out["parity"].append(parity(own))
                    out["fold"].append(odd_bits(own, FOLD_BITS))
            kinds = {"n": pa.int64(), "common": pa.float64(), "hubs": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    schema = "doc_id long, n long, common double, digest binary, hubs array<long>, prefix binary, parity binary, fold binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(tk.tidy(run), schema)


def members(pairs: DataFrame) -> DataFrame:
    """(id) of all documents in ``pairs``, for a broadcast if they are few."""
    return small(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))


def once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with one row for each id that ``rows`` (doc_id) holds more than
    once, so that no fragment of theirs counts twice."""
    again = cut(rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if again.isEmpty():
        return docs
    again = small(again)
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(one)


def linked(pairs: DataFrame, docs: DataFrame, shared, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) that are similar enough: fragments of
    both sets are joined, overlaps counted in each and summed per pair.
    ``docs`` must hold each id once."""

    def segments(batches):
        order = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for lo, n, value, at in _sets(batch, words):
                for r, own in enumerate(tk.row_sets(value, at, n)):
                    out += [(int(ids[lo + r]), f, part.tobytes()) for f, part in enumerate(order.fragments(own)) if len(part)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "fragment", "segment"])

    def overlaps(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            common = [len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])

    ids = members(pairs).withColumnRenamed("id", "doc_id")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).join(ids, "doc_id", "left_semi")
    sets = cut(source.mapInArrow(tk.tidy(segments), "id long, fragment int, segment binary"))
    first = pairs.join(sets.select(F.col("id").alias("a"), "fragment", F.col("segment").alias("x")), "a")
    second = first.join(sets.select(F.col("id").alias("b"), "fragment", F.col("segment").alias("y")), ["b", "fragment"])
    partial = second.select("a", "b", "na", "nb", "x", "y").mapInArrow(tk.tidy(overlaps), "a long, b long, na long, nb long, common long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b", "common")


def hub_pairs(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, na, nb): each of ``nodes`` (id, n, common, hubs) with the hub of
    each of its buckets, where sizes allow a link. The hub is the member that
    meets the most others in its buckets, of equal ones (edits often leave all
    buckets as they are) that with the most common shingles, so the least edited
    copy of a group rather than any one of them."""
    buckets = nodes.select("id", "n", "common", F.explode("hubs").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut(buckets.join(shared, "bucket"))
    met = met.join(met.groupBy("id").agg(F.sum("size").alias("met")), "id")
    hubs = met.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), (-F.col("common")).alias("common"), "id", "n")).alias("hub"))
    starred = met.join(hubs, "bucket").where("id <> hub.id").where(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    ordered = F.when(F.col("id") < F.col("hub.id"), F.struct(F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb")))
    ordered = ordered.otherwise(F.struct(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")))
    return starred.select(ordered.alias("p")).select("p.*").distinct()


def prefix_entries(nodes: DataFrame) -> DataFrame:
    """(token, id, n, place): the prefixes of ``nodes`` (id, n, label, prefix)
    as posting lists, those only that hold more than one label."""

    def postings(batches):
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            counts = np.array([len(x) for x in tokens], dtype=np.int64)
            if not counts.sum():
                continue
            ids, sizes, labels = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("id", "n", "label"))
            where = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = pa.RecordBatch.from_pydict({"token": np.concatenate(tokens), "id": ids, "n": sizes.astype(np.int32), "place": where.astype(np.int32), "label": labels})
            yield from (rows.slice(at, BATCH_ROWS) for at in range(0, rows.num_rows, BATCH_ROWS))

    rows = nodes.select("id", "n", "label", "prefix").mapInArrow(tk.tidy(postings), "token long, id long, n int, place int, label long")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return rows.select("token", "id", "n", "place").join(mixed, "token")


def entry_pairs(entries: DataFrame, nodes: DataFrame, nearest: bool, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, na, nb) of ``nodes`` (id, label, fold) with different labels
    that meet in a posting list and pass the bounds on size, place and sketch;
    with ``nearest`` only those that are, of one of the two, the closest by
    sketch in a list.

    A list is cut into bands of size: a set meets those of its own band and the
    larger ones of the next, of which it is a guest. A band of more than BLOCK
    members is cut again into blocks, of which each two meet in a task."""
    step = 1.0001 * max(-math.log(percent / 100), 0.01)  # a little wider than the bound, for rounding
    band = F.floor(F.log("n") / step).cast("int")
    placed = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))))
    marks = nodes.select("id", "label", "fold").join(small(cut(entries.select("id").distinct())), "id", "left_semi")
    dealt = entries.join(marks, "id").select("*", placed.alias("in")).select("token", "in.band", "in.guest", "id", "n", "place", "label", "fold")
    lists = dealt.groupBy("token", "band").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("guest").alias("guests"))
    lists = lists.where("lo <> hi and not guests").select("token", "band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    blocked = dealt.join(lists, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = other.select("token", "band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "guest", "id", "n", "place", "label", "fold")

    def meet(columns, fold):
        """Pairs of whole groups, sorted by group and label."""
        token, band, p, q, block, guest, ids, sizes, place, labels = columns
        change = np.zeros(len(ids), dtype=bool)
        for x in (token, band, p, q):
            change[1:] |= x[1:] != x[:-1]
        last = np.append(np.flatnonzero(change), len(ids))
        end = last[np.searchsorted(last, np.arange(len(ids)), side="right")]  # of the group
        run = np.append(np.flatnonzero(change | np.append(False, labels[1:] != labels[:-1])), len(ids))
        ahead = run[np.searchsorted(run, np.arange(len(ids)), side="right")]  # of the next label
        at, found = np.flatnonzero(ahead < end), []
        step = 0
        while len(at):
            to = ahead[at] + step
            near = np.minimum(sizes[at], sizes[to]) * 100 >= np.maximum(sizes[at], sizes[to]) * percent
            total = sizes[at] + sizes[to]
            left = np.minimum(sizes[at] - place[at], sizes[to] - place[to])
            near &= left >= (total * percent + 99 + percent) // (100 + percent)
            # Two guests meet in their own band; of one block, in the group of that block alone.
            near &= ~(guest[at] & guest[to]) & ((p[at] == q[at]) | (block[at] != block[to]))
            x, y, most = at[near], to[near], total[near] * (100 - percent) // (100 + percent)
            apart = np.bitwise_count(fold[x] ^ fold[y]).sum(axis=1, dtype=np.int64)
            ok = apart <= most
            if ok.any():
                found.append(np.stack((x[ok], y[ok], apart[ok] * 1_000_000 // (total[near][ok]))))
            step += 1
            at = at[ahead[at] + step < end[at]]
        if not found:
            return np.empty((4, 0), np.int64)
        x, y, apart = np.concatenate(found, axis=1)
        if nearest:
            rows, score, pair = np.concatenate((x, y)), np.tile(apart, 2), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((pair, score, rows))
            best = np.unique(pair[order][np.append(True, np.diff(rows[order]) != 0)])
            x, y = x[best], y[best]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        return np.unique(np.stack((ids[x], ids[y], sizes[x], sizes[y])), axis=1)

    def pairs(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "band", "p", "q", "block", "guest", "id", "n", "place", "label")]
                own[7:9] = [x.astype(np.int64) for x in own[7:9]]
                own.append(np.frombuffer(b"".join(batch.column("fold").to_pylist()), np.uint64).reshape(-1, FOLD_BITS // 64))
                rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
                if not len(rest[0]):
                    continue
                same = np.logical_and.reduce([x == x[-1] for x in rest[:4]])
                end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            elif rest is None:
                return
            else:
                end = len(rest[0])
            if end:
                out = meet([x[:end] for x in rest[:10]], rest[10][:end])
                if out.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "na", "nb"])
                rest = [x[end:] for x in rest]

    def _with_end(batches):
        yield from batches
        yield None

    key = ["token", "band", "p", "q"]
    sorted_lists = keyed.repartition(partitions(nodes.sparkSession), *key).sortWithinPartitions(*key, "label")
    return sorted_lists.mapInArrow(tk.tidy(pairs), "a long, b long, na long, nb long").distinct()


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the label of their component."""
    return nodes.join(connected(links), "id", "left").withColumn("label", F.coalesce("label", "id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (size of
    its set) and component_id (smallest doc_id reachable by links, itself
    included).

    Words are runs of bytes outside ASCII white space, A-Z in lower case. A
    text of fewer words than a shingle is one shingle; null, empty and white
    texts have none and stay alone. Ids should be unique (repeated equal rows
    are each returned); rows with a null id stay alone. An empty table gives an
    empty result; further columns of ``docs`` are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(GlobalOrder(count_sketch(docs, words)))
    tk.release()
    rows = cut(signatures(docs, shared, words, percent))
    known = rows.where("n > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("id"))
    nodes = cut(known.withColumnRenamed("doc_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["id", "digest"]).select("id", "n", "common", "hubs", "prefix", "parity", "fold"))
    source = once(docs, rows)
    count = lambda pairs: cut(linked(cut(screened(pairs, nodes, percent)), source, shared, words, percent).select("a", "b"))

    links = count(cut(hub_pairs(nodes, percent)))
    entries = cut(prefix_entries(labelled(nodes, links)))
    for _ in range(NEAREST_ROUNDS):
        # Whoever has no partner in a round has none later, since components only grow.
        pairs = cut(entry_pairs(entries, labelled(nodes, links), True, percent))
        entries = cut(entries.join(members(pairs), "id", "left_semi"))
        links = links.unionByName(count(pairs))
    links = links.unionByName(count(cut(entry_pairs(entries, labelled(nodes, links), False, percent))))
    labels = connected(links)

    of_class = classes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
