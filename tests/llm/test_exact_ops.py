"""Exact deduplication, Jaccard components and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import decontaminate, exact_dedup, jaccard_join
from tallywright.llm import textkernel as tk
from tallywright.llm.components import connected

DOCS = "doc_id long, text string, lang string, digest string, _text string, n long"
random.seed(5)


@pytest.fixture(autouse=True)
def seeded(request):
    """Each test draws from a stream of its own, whatever ran before it."""
    random.seed(request.node.name)


WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]


def prose(n):
    return " ".join(random.choice(WORDS) + str(random.randrange(40)) for _ in range(n))


def table(spark, texts, start=0):
    """Documents whose other columns clash with names used inside."""
    return spark.createDataFrame([(start + i, t, "en", "x", "y", 1) for i, t in enumerate(texts)], DOCS)


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[random.randrange(len(words))] = "changed" + str(random.randrange(10**6))
    return " ".join(words)


# Exact deduplication


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string")])
def test_exact_groups(spark, digest):
    """With a digest that often clashes, texts still decide."""
    texts = [None, "", "a", "b", "a", " a", "A", prose(3000), "c"] + ["hot"] * 60 + ["b"]
    got = exact_dedup.exact_groups(table(spark, texts), digest=digest).collect()
    want = {x[:4] for x in brute_groups(enumerate(texts))}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(texts)
    if digest is exact_dedup.sha256:
        assert {tuple(r) for r in got} == brute_groups(enumerate(texts))


def test_exact_edge_cases(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    repeated = table(spark, ["a", "b"]).union(table(spark, ["a", "b"]))
    assert {(r.doc_id, r.group_size) for r in exact_dedup.exact_groups(repeated).collect()} == {(0, 2), (1, 2)}
    kept = exact_dedup.deduplicate(table(spark, ["a", "a", None, ""]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


# Jaccard components


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies():
    out = [None, "", " \n\t ", "one", "ONE", "one two", "one  two ", "one two three", "a b c d", "A B\vC D"]
    for size in (5, 30, 80, 200, 900):
        base = prose(size)
        out += [base, base.upper() if base.isascii() else base] + [edited(base, e) for e in (0, 1, 1, 2, 3, 5, 8) for _ in range(3)]
    passage = prose(60)
    out += [prose(40) + " " + passage + " " + prose(40) for _ in range(25)]  # share a passage, aren't alike
    chain = prose(100)
    for _ in range(12):  # each like the one before only
        chain = edited(chain, 1)
        out.append(chain)
    return out + [prose(20000)]


def test_jaccard_components(spark):
    texts = near_copies()
    random.shuffle(texts)
    got = jaccard_join.jaccard_components(table(spark, texts))
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()} == brute_components(enumerate(texts))


@pytest.mark.parametrize("block", [3, 2048])
def test_prefix_pairs_alone_lose_nothing(spark, monkeypatch, block):
    """Without the hubs' links the prefixes still lead to every link, in blocks of any size."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies()
    docs = table(spark, texts)
    shared = spark.sparkContext.broadcast(jaccard_join.GlobalOrder(jaccard_join.count_sketch(docs)))
    nodes = jaccard_join.signatures(docs, shared).where("n > 0").withColumnRenamed("doc_id", "id").withColumn("label", F.col("id")).cache()
    entries = jaccard_join.prefix_entries(nodes).cache()
    pairs = jaccard_join.screened(jaccard_join.entry_pairs(entries, nodes, False), nodes).cache()
    nearest = {tuple(r) for r in jaccard_join.entry_pairs(entries, nodes, True).collect()}
    assert nearest <= {tuple(r) for r in jaccard_join.entry_pairs(entries, nodes, False).collect()}
    found = connected(jaccard_join.linked(pairs, docs, shared).select("a", "b"))
    want = {(i, c) for i, n, c in brute_components(enumerate(texts)) if n}
    got = {r.id: r.label for r in found.collect()}
    assert {(i, got.get(i, i)) for i, _ in want} == want


@pytest.mark.parametrize("seed", range(4))
def test_large_group_of_near_copies(spark, seed):
    """2,000 near copies, and as many texts that share half of their words: pairs stay linear in them."""
    random.seed(seed)
    base, other = prose(120), prose(60)
    texts = [edited(base, random.randrange(5)) for _ in range(2000)] + [other + " " + prose(60) for _ in range(500)]
    docs = table(spark, texts)
    shared = spark.sparkContext.broadcast(jaccard_join.GlobalOrder(jaccard_join.count_sketch(docs)))
    nodes = jaccard_join.signatures(docs, shared).withColumnRenamed("doc_id", "id").dropDuplicates(["digest"]).cache()
    hubs = jaccard_join.hub_pairs(nodes)
    assert hubs.count() <= 4 * len(texts)
    links = jaccard_join.linked(jaccard_join.screened(hubs, nodes), docs, shared).select("a", "b").cache()
    marked = jaccard_join.labelled(nodes, links).cache()
    entries = jaccard_join.prefix_entries(marked).cache()
    assert jaccard_join.entry_pairs(entries, marked, True).count() <= 2 * entries.count()
    assert jaccard_join.entry_pairs(entries, marked, False).count() <= 10 * len(texts)


def test_jaccard_edge_cases(spark):
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0
    assert {tuple(r) for r in jaccard_join.jaccard_components(table(spark, [None, "", "x"])).collect()} == {(0, 0, 0), (1, 0, 1), (2, 1, 2)}
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (9, "A b c d")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(nulls).collect()), key=str) == [(4, 1, 4), (9, 1, 4), (None, 1, None), (None, 1, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(1, 90)).astype(np.uint64))))
        a = np.unique(a)
        assert jaccard_join.differing(jaccard_join.parity(a), jaccard_join.parity(b)) <= len(np.setxor1d(a, b))


# Decontamination


def distance(p, t):
    """Least edits between p and any piece of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_distance():
    rng = np.random.default_rng(0)
    for _ in range(100):
        t = rng.integers(0, 4, 60)
        p = t[20:45].copy()
        for _ in range(rng.integers(0, 4)):
            i = rng.integers(0, len(p))
            p = [np.delete(p, i), np.insert(p, i, 9), np.concatenate((p[:i], [8], p[i + 1 :]))][rng.integers(0, 3)]
        found, want = decontaminate.banded_distance(p, t, -5, 60, 10), distance(list(p), list(t))
        assert found[0] == want and distance(list(p), list(t[found[1] : found[2]])) == want


def letters(n):
    return "".join(random.choice("abcdefghij klmno é") for _ in range(n))


def spoil(text, edits):
    out = list(text)
    for _ in range(edits):
        i = random.randrange(len(out))
        random.choice([lambda: out.__setitem__(i, "#"), lambda: out.insert(i, "%"), lambda: out.pop(i)])()
    return "".join(out)


def test_leaks_equal_brute_force(spark):
    """Every window within its edit budget is found, by alignment of all windows with all texts."""
    items = [(i, " ".join(letters(n).split())) for i, n in enumerate((30, 80, 120, 200, 300))] + [(9, "short"), (10, None)]
    texts = [letters(400) for _ in range(4)] + [None, "", "x"]
    for _, item in items[:5]:
        for e in (0, 1, 2, 4, 6, 9, 14):
            texts.append(letters(150) + spoil(item, e).upper().replace(" ", " \n ") + letters(90))
        texts.append(letters(50) + item[: len(item) // 2] + letters(50))
    index = decontaminate.build_index(items)
    normal = lambda t: " ".join((t or "").lower().split())
    want = set()
    for d, t in enumerate(texts):
        for k, own in enumerate(index.ids):
            pattern = "".join(map(chr, index.codes[k]))
            if any(distance(pattern[b : b + w], normal(t)) <= e for b, w, e, _ in index.windows[k]):
                want.add((d, own))
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == want and len(want) > 20
    clean = decontaminate.without_leaks(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and clean.columns == docs.columns
    assert set(clean.collect()) <= set(docs.collect())


def test_leaks_edge_cases(spark):
    benchmark = spark.createDataFrame([(1, letters(100))], "item_id long, text string")
    assert decontaminate.leaks(table(spark, []), benchmark).count() == 0
    assert decontaminate.leaks(table(spark, ["a"]), benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(table(spark, [None, "a"]), benchmark.limit(0)).count() == 2


def test_benchmark_in_blocks(spark, monkeypatch):
    """A benchmark over the bound is looked for in several passes."""
    items = [(i, letters(100)) for i in range(12)]
    docs = table(spark, [letters(60) + t + letters(60) for _, t in items])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}


# Text kernel


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["a b\tc  d e", None, "", " x ", "A", "ab", "a b", "\x1cq"]
    data, offsets = tk.buffers(pa.array(texts))
    starts, ends, rows = tk.word_spans(data, offsets)
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows, strict=True):
        got[r].append(bytes(data[s:e]).decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert list(tk.chunks(np.array([0, 3, 3, 900, 901]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_leaks_do_not_depend_on_alignment(spark):
    """Pieces of a window's length from any place of an item, with and without edits, and short items."""
    pick = random.Random(11)
    make = lambda n: "".join(pick.choice("abcdefghijklmno") for _ in range(n))
    item = make(400)
    items = [(1, item), (2, "What is six  by Seven?"), (3, "42"), (4, "日本"), (5, " ")]
    pieces = [make(80) + item[b : b + 120] + make(80) for b in (0, 8, 29, 31, 95, 210, 271)]
    pieces += [make(80) + item[b : b + 40] + "#" + item[b + 41 : b + 80] + "%%" + item[b + 82 : b + 120] + make(80) for b in (28, 150, 211)]
    texts = pieces + ["(what is SIX by\nseven?)", "x42 420 4242", "it is 42.", "42", "これは日本です", "a " + item[30:120] + " b"]
    want = {(i, 1) for i in range(len(pieces))} | {(10, 2), (12, 3), (13, 3), (14, 4)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(table(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.edits <= 7 and min(r.end, 200) - max(r.begin, 80) >= 106 for r in found if r.doc_id < 7), found
    assert {r.doc_id for r in decontaminate.without_leaks(table(spark, texts), benchmark.where("item_id > 1")).collect()} == set(range(16)) - {10, 12, 13, 14}


def test_repeated_rows_make_no_false_link(spark):
    """Pairs just under the threshold, some of which pass the odd sketches, with their rows repeated."""
    pick, texts = random.Random(17), []
    for _ in range(40):
        words = [f"w{pick.randrange(10**6)}" for _ in range(200)]
        near = list(words)
        for i in (40, 80, 120, 160):
            near[i] = f"x{pick.randrange(10**6)}"
        texts += [" ".join(words), " ".join(near)]
    docs = table(spark, texts)
    want = brute_components(enumerate(texts))
    assert len({c for _, _, c in want}) == len(texts)
    got = jaccard_join.jaccard_components(docs.union(docs))
    rows = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()]
    assert set(rows) == want and len(rows) == 2 * len(texts)


def test_bands_in_slices_are_those_of_one_slice(monkeypatch):
    """Shared, repetitive and edited items: slices of few hits keep the same bands, counted by brute force."""
    pick = random.Random(23)
    letters = lambda n: "".join(pick.choice("abcdefgh ij") for _ in range(n))
    items = [letters(200), letters(40), "-" * 150, "ab" * 60]
    items.append(items[0][:120] + letters(60))
    texts = [letters(50) + items[0][20:190] + letters(30) + "-" * 160, None, "ab" * 90, letters(300), items[1] + items[4], ""]
    index = decontaminate.build_index(list(enumerate(items)))
    hit = index.table()
    whole = list(decontaminate._scan(index, hit, pa.array(texts, pa.string())))
    assert {(r, it) for r, it, *_ in whole} >= {(0, 0), (0, 2), (2, 3), (4, 1), (4, 4)}
    for hits in (911, 20_000):
        monkeypatch.setattr(decontaminate, "SLICE_HITS", hits)
        assert list(decontaminate._scan(index, hit, pa.array(texts, pa.string()))) == whole


def test_hits_of_a_band_by_brute_force():
    rng = np.random.default_rng(3)
    for step in (1, 3):
        text, own = rng.integers(0, 3, 50).astype(np.uint64), rng.integers(0, 3, 20).astype(np.uint64)
        for band in range(-9, 20):
            want = [(p, d) for p in range(20) for d in range(band * step, (band + 2) * step) if 0 <= p + d < 50 and text[p + d] == own[p]]
            place, diagonal = decontaminate.band_hits(text, own, band, step)
            assert sorted(zip(place.tolist(), diagonal.tolist(), strict=True)) == want


def test_decontamination_of_repetitive_text_keeps_memory_bounded():
    import tracemalloc

    index = decontaminate.build_index([(1, "-" * 1000)])
    hit = index.table()
    tracemalloc.start()
    found = sum(1 for _ in decontaminate._scan(index, hit, pa.array(["-" * 6000])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and most < 200_000_000


def test_decontamination_edge_cases_of_rows(spark):
    """Ids as text, null ids and repeated rows."""
    item = "the quick brown fox jumps over the lazy dog while seven wizards box"
    docs = spark.createDataFrame([("1", f"so {item} it goes"), ("1", f"so {item} it goes"), (None, item), ("2", None)], "doc_id string, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, None)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()), key=str) == [(1, 5), (1, 5), (None, 5)]
