"""Collocations against a count of every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, n long, score double, words string"
SMALL = 1 << 17


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        candidates = {g for g, c in counts.items() if len(g) > 1 and c >= least}
        found = []
        for g in candidates:
            a = counts[g]
            if any(len(h) > len(g) and 100 * counts[h] >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h in candidates):
                continue
            score, _, x, y = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), x, y))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "p", 1, 0.5, "w") for i, (t, x) in enumerate(rows)], DOCS).repartition(5)


def made(seed, texts=60):
    draw = random.Random(seed)
    words = ["New", "York", "new", "of", "the", "is", "é", "É", "ß", "🙂", "a b", "c\x1cd", "x-y"]
    set_phrases = ["in spite of", "as well as the", "New York", "one two three four"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " ; ", "!?"]
    rows = [(None, "en"), ("", None), (" \t\n", "xx"), (".,;:", "en"), ("lonely", "yy")]
    for _ in range(texts):
        parts = [draw.choice(words if draw.random() < 0.7 else set_phrases) + draw.choice(gaps) for _ in range(draw.randint(1, 60))]
        rows.append(("".join(parts), draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 2000), (2, 8, 15), (3, 1, 40)])
def test_equals_brute_force(spark, seed, least, top):
    rows = made(seed)
    got = co.collocations(table(spark, rows), least=least, top=top, cells=SMALL).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, top)


def test_long_text_in_slices_counts_once(spark, monkeypatch):
    """Slices of 64 bytes: phrases across their ends count once, others too."""
    rows = [("ab cd, ef gh ab cd " * 300 + "z" * 500 + " ab cd", "en"), ("ab.cd.ef" * 50, "en"), ("q" * 2000, "en"), ("ab cd ef", "de")]
    words, languages = co.Numbers(), co.Numbers()
    f, _ = counted(rows)
    batch = pa.record_batch([pa.array([t.encode() for t, _ in rows]), pa.array([x for _, x in rows])], names=["t", "l"])
    got = {}
    for chunk in co.word_chunks([batch], words, languages, 64):
        for n, places, counts in chunk.grams(4, words):
            for p, c in zip(places, counts, strict=True):
                key = (languages.names[chunk.langs[p]].decode(), tuple(words.names[i].decode() for i in chunk.ids[p : p + n]))
                got[key] = got.get(key, 0) + int(c)
    assert {k: c for k, c in got.items() if c} == {(x, g): c for x, counts in f.items() for g, c in counts.items()}


def test_vocabulary_that_begins_anew(spark, monkeypatch):
    monkeypatch.setattr(co, "VOCABULARY", 3)
    words, languages = co.Numbers(), co.Numbers()
    batch = pa.record_batch([pa.array([b"a b c d e f"] * 40), pa.array([f"l{i % 7}" for i in range(40)])], names=["t", "l"])
    total = 0
    for chunk in co.word_chunks([batch], words, languages, 30):
        total += sum(int(c.sum()) for n, _, c in chunk.grams(4, words) if n == 4)
    assert total == 40 * 3


def test_sketch_never_counts_too_little():
    """Cells stop at the threshold; merging and counting keep every frequent key."""
    draw = np.random.default_rng(4)
    at, counts = draw.integers(0, 50, 5000), draw.integers(1, 31, 5000)
    cells = np.zeros(64, np.uint8)
    co._count(cells, at, counts, 30)
    assert (cells == np.minimum(np.bincount(at, weights=counts, minlength=64), 30)).all()
    parts = [draw.integers(0, 31, 64).astype(np.uint8) for _ in range(5)]
    total = np.zeros(64, np.uint8)
    for p in parts:
        co._add(total, p, 30)
    assert (total == np.minimum(sum(p.astype(int) for p in parts), 30)).all()


def test_grouped_both_ways():
    draw = np.random.default_rng(5)
    for values in (draw.integers(0, 9, 100), draw.integers(0, 9, 100) + (1 << 60), np.array([7])):
        first, counts, rank = co.grouped(values)
        want, at, inverse, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        assert (values[first] == want).all() and (first == at).all() and (counts == n).all() and (rank == inverse).all()


def test_survivors_are_few(spark):
    """Rare phrases are ruled out by the sketch before they are counted."""
    rows = [(" ".join(f"w{i}x{j}" for j in range(400)) + " both words", "en") for i in range(60)]
    df = table(spark, rows)
    parts = co.sketches(df, "text", "lang", 30, SMALL)
    reached = spark.sparkContext.broadcast([(r.block, bytes(r.reached)) for r in co.merged(parts, 30, 3).collect()])
    alive = {r.phrase for r in co.survivors(df, "text", "lang", reached, SMALL).collect()}
    assert {"both", "words", "both words"} <= alive and len(alive) < 2000  # of some 96,000


def test_scores_beyond_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", "a", 1, 2**63 - 1), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, size int, f long")
    r = co.scored(counts).first()
    assert (r.a, r.l, r.r, r.score) == (big, 2**63 - 1, big + 1, 2_000_000 * big // (2**63 + big))
    longer = spark.createDataFrame([("en", "a b", 2, 2**62), ("en", "a b c", 3, 2**62 * 4 // 5 + 1), ("en", "b c", 2, 2**63 - 1)], "lang string, phrase string, size int, f long")
    assert [r.phrase for r in co.subsumed(longer).collect()] == ["a b"]


def test_ties_hot_words_and_repeated_rows(spark):
    rows = [("the x, the y, the Z", "en")] * 40 + [("the x", "en")] * 3
    got = co.collocations(table(spark, rows), least=30, cells=SMALL).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 30, 2000) and [r.phrase for r in sorted(got, key=lambda r: r.rank)] == ["the x", "the y", "the z"]


def test_empty_table_and_bad_size(spark):
    assert co.collocations(table(spark, []), cells=SMALL).count() == 0
    with pytest.raises(ValueError):
        co.collocations(table(spark, []), cells=1000)


def test_more_cells_than_a_task_can_hold(spark):
    """Cells may outnumber the phrases of any corpus: a task holds only those it meets."""
    rows = made(7)
    got = co.collocations(table(spark, rows), least=3, cells=1 << 42).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 2000)


def test_default_cells_rule_out_rare_phrases_of_gigabytes():
    """6 GB of Parquet hold some 1.6e9 words, so four times as many phrases: cells of only rare ones stay far below the threshold."""
    assert 4 * 1.6e9 / co.CELLS < co.LEAST / 10


def test_runs_that_end_within_a_text(spark, monkeypatch):
    monkeypatch.setattr(co, "RUN", 7)
    rows = made(8, 20)
    got = co.collocations(table(spark, rows), least=2, cells=SMALL).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 2000)


@pytest.mark.parametrize(("size", "hot"), [(50, 0), (3000, 0), (3000, 70_000)])
def test_cell_numbers_packed_and_unpacked(size, hot):
    draw = np.random.default_rng(6)
    numbers = np.sort(np.append(draw.integers(0, 1 << 24, size), np.full(hot, (1 << 24) - 1)).astype(np.uint64))
    got = [co.unpacked(groups, pa.py_buffer(data)).astype(np.uint64) + np.uint64(first) for first, groups, data in co.packed(numbers, 1 << 24, 8)]
    assert (np.concatenate(got) == numbers).all()
    for some in (np.unique(numbers), numbers[:1], np.array([0, 1, 300, 1 << 17, 1 << 50, (1 << 50) + 1], np.uint64)):
        assert (co.unpacked_set(co.packed_set(some)) == some).all()
    bits = np.unpackbits(co.bitmap([co.packed_set(np.unique(numbers))], 1 << 24), bitorder="little")
    assert (np.flatnonzero(bits) == np.unique(numbers)).all()


def test_phrase_around_a_rare_one_is_not_counted(spark):
    """Of cells that are told, "a b" is missing: "a b c" is left out though its own cell is there."""
    df = spark.createDataFrame([("a b c",)] * 3, "text string").selectExpr("text", "'en' AS lang")
    words, languages = co.Numbers(), co.Numbers()
    (chunk,) = co.word_chunks([pa.record_batch([pa.array([b"a b c"]), pa.array(["en"])], names=["t", "l"])], words, languages)
    cell_of = co.Cells(chunk, words, languages, 40)
    cells = {n: cell_of(n, places) for n, places in chunk.places(3)}
    told = np.sort(np.concatenate([cells[1], cells[2][1:], cells[3]]))
    reached = spark.sparkContext.broadcast([(0, co.packed_set(told >> np.uint64(10)))])
    assert {r.phrase for r in co.survivors(df, "text", "lang", reached, 1 << 30).collect()} == {"a", "b", "c", "b c"}


def test_threshold_of_none_is_that_of_one(spark):
    rows = made(9, 5)
    got = co.collocations(table(spark, rows), least=0, cells=SMALL).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 1, 2000)
