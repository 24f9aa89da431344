"""Tokenisers, packing, chat windows and license scans: exact round trips."""

import collections
import hashlib
import math
import os
import random
import textwrap

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import chat_format, licenses, packing, sentencepieces, wordpieces

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepieces.DEFAULT), reason="no tokenizer files")
HARD = ["", "  x  ", " ", "\n", "a\n\n b  \nc\n", "Hello  World\n\tfoo é bar ", "▁x ﬁ ▁▁y\r\n", "▁", "日本語 𝄞 x", "ab\x00c", "﷐ ▁ ﷐"]
DOCS = "doc_id long, text string, ids string, sample int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


# SentencePiece


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_encoding_is_the_librarys_and_decodes(text):
    model = sentencepieces.piece_model()
    ids = model.encode(text)
    assert model.decode_bytes(ids) == text.encode()
    if sentencepieces.SPACE not in text:
        assert ids.tolist() == model.library.encode(text)


def test_samples_are_distinct_and_decode():
    model = sentencepieces.piece_model()
    found = sentencepieces.segment_chunk(model, HARD, np.arange(len(HARD), dtype=np.uint64), 4)
    for text, own in zip(HARD, found, strict=True):
        assert all(model.decode_bytes(x[0]) == text.encode() for x in own)
        samples = own[1:]
        assert samples and len({x[0].tobytes() for x in samples}) == len(samples)
        assert [x[2] for x in samples] == sorted((x[2] for x in samples), reverse=True)
        assert all(x[3] <= 0 for x in samples)


def brute(model, text):
    """Probability of every segmentation."""
    weight = {i: w for i, w in zip(model.ids.tolist(), model.weights.tolist(), strict=True)}
    full, out = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE), {}

    def grow(at, ids, total):
        if at == len(full):
            out[ids] = total
        for size in range(1, model.longest + 1):
            i = model.library.piece_to_id(full[at : at + size]) if at + size <= len(full) else 0
            if i in weight:
                grow(at + size, (*ids, i), total + weight[i])

    grow(0, (), 0.0)
    z = math.log(sum(map(math.exp, out.values())))
    return {k: v - z for k, v in out.items()}


def test_sampling_follows_the_distribution():
    """First and second draw as in sampling without replacement from all segmentations."""
    model, n, text = sentencepieces.piece_model(), 12000, "an on"
    log = brute(model, text)
    found = sentencepieces.segment_chunk(model, [text] * n, np.arange(n, dtype=np.uint64), 2)
    pairs = collections.Counter(tuple(tuple(x[0].tolist()) for x in own[1:]) for own in found)
    assert found[0][1][1] == pytest.approx(log[tuple(found[0][1][0].tolist())], abs=1e-4)
    top = max(log, key=log.get)
    rest = sum(math.exp(v) for k, v in log.items() if k != top)
    for k in sorted(log, key=log.get)[-4:-1]:
        assert pairs[top, k] / n == pytest.approx(math.exp(log[k]) / rest, abs=0.02)


def test_segmentations_table(spark):
    df = docs(spark, [*HARD, None, "word " * 30000])
    out = sentencepieces.segmentations(df).cache()
    assert all(r.restored for r in out.collect()) and {r.doc_id for r in out.collect()} == set(range(len(HARD) + 2))
    back = {(r.doc_id, r.sample): r.text for r in sentencepieces.decode(out).collect()}
    assert all(back[i, 0] == t for i, t in enumerate(HARD))
    again = {(r.doc_id, r.sample): r.ids for r in sentencepieces.segmentations(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for r in out.collect()}
    assert sentencepieces.segmentations(df.limit(0)).count() == 0


def test_units_of_earlier_chunks_are_not_made_again(monkeypatch):
    model, made = sentencepieces.PieceModel(sentencepieces.DEFAULT), []
    encode = model.encode_units
    monkeypatch.setattr(model, "encode_units", lambda units: made.extend(units) or encode(units))
    keys = np.arange(2, dtype=np.uint64)
    first = sentencepieces.segment_chunk(model, ["one two three\n", "two one"], keys, 2)
    assert sorted(made) == ["\n", "one", "three", "two"]
    made.clear()
    again = sentencepieces.segment_chunk(model, ["one two three\n", "two one four"], keys, 2)
    assert made == ["four"] and [(x[0].tolist(), *x[1:]) for x in again[0]] == [(x[0].tolist(), *x[1:]) for x in first[0]]


def test_results_do_not_depend_on_the_units_kept(monkeypatch):
    """The same with units taken in anew, kept, and thinned out before each chunk."""
    rng = random.Random(7)
    words = ["".join(rng.choices("aeinorst\u00e9\u65e5", k=rng.randint(1, 9))) for _ in range(300)]
    chunks = [[*HARD, *(" ".join(rng.choices(words[: 30 * (c + 1)], k=80)) for _ in range(6))] for c in range(8)]

    def found(renew):
        model, out = sentencepieces.PieceModel(sentencepieces.DEFAULT), []
        for c, texts in enumerate(chunks):
            if renew:
                model.known.clear()
            for own in sentencepieces.segment_chunk(model, texts, np.arange(len(texts), dtype=np.uint64) + np.uint64(100 * c), 3):
                out += [(x[0].tolist(), *x[1:]) for x in own]
        return out, len(model.known[True].place)

    want, _ = found(True)
    kept, everything = found(False)
    monkeypatch.setattr(sentencepieces, "KEPT_STATES", 1000)
    thinned, some = found(False)
    assert want == kept == thinned and some < everything


# Packing


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit_is_best_fit(sizes):
    """Same rows' rooms as a search over all open rows."""
    rows = packing.best_fit(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 50 for r in rows)
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(50 - size)
    assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_round_trip(spark):
    texts = [*HARD, None, "long words " * 5000, *["x y z " * random.Random(i).randrange(1, 400) for i in range(60)]]
    rows = packing.packed(docs(spark, texts), capacity=256, window_tokens=5000).cache()
    encoder = wordpieces.byte_encoder()
    back = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2") for r in packing.unpacked(rows).collect()}
    for i, t in enumerate(texts):
        assert encoder.decode(back[i][:-1]) == (t or "").encode() and back[i][-1] == wordpieces.END_OF_TEXT
    for r in rows.collect():
        assert len(r.ids) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.resets == r.cu_seqlens[:-1]
        places = packing.positions(r.cu_seqlens, 256)
        assert all(places[a] == 0 for a in r.resets) and np.count_nonzero(np.diff(places[: r.n_tokens]) != 1) == len(r.resets) - 1
    assert rows.select("pack_id").distinct().count() == rows.count()
    assert packing.packed(docs(spark, []).limit(0)).count() == 0


def test_unpacking_keeps_repeated_rows_and_null_ids_apart(spark):
    rows = [(7, "first"), (7, "second " * 300), (7, "first"), (None, "no id " * 200), (None, "no id either"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    back = packing.unpacked(packing.packed(df, capacity=64, window_tokens=500)).collect()
    encoder = wordpieces.byte_encoder()
    got = [(r.doc_id, encoder.decode(np.frombuffer(bytes(r.ids), "<u2")[:-1]).decode()) for r in back]
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in rows], key=str)


# Chat


@given(st.text(alphabet="<|~>im_start end\\n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_escape_round_trip(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text and "<|" not in hidden
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, window string, n_tokens int")


def test_windows_read_back(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief"))
        for t in range(1, rng.randrange(2, 30)):
            rows.append((c, t, "user" if t % 2 else "assistant", rng.choice([None, "", "<|im_end|>\n<|im_start|>assistant", "word " * rng.randrange(1, 120)])))
    rows += [(99, 0, None, "no role"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a"), (None, 0, "user", "stray"), (7, 500, "assistant", "huge " * 3000)]
    windows = chat_format.format_windows(turns(spark, rows), budget=200, history_tokens=80).cache()
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    assert got.keys() == by.keys()
    for c, own in by.items():
        said = "".join(t for role, t in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in windows.collect():
        assert w.n_tokens <= 200 or w.over_budget
        shown = chat_format.parse_turns(w.text)
        assert not w.over_budget or len(shown) - w.n_history - w.has_system == 1
        assert w.has_system == (w.window > 0 and by[w.conv_id][0][0] == "system") and (not w.has_system or shown[0][0] == "system")
    assert chat_format.read_back(chat_format.format_windows(turns(spark, rows).limit(0))).count() == 0


def test_roles_and_escapes_count_in_the_budget(spark):
    """A window's tokens are those of what is written, role and escapes included."""
    rows = [(1, 0, "r" * 3000, "a"), (1, 1, "user", "<|" * 300), (1, 2, "assistant", "b")]
    windows = chat_format.format_windows(turns(spark, rows), budget=500, history_turns=0).orderBy("window").collect()
    count = wordpieces.byte_encoder().count
    for w in windows:
        own = chat_format.parse_turns(w.text)
        assert w.n_tokens == sum(count(chat_format.escape_role(r)) + count(chat_format.escape(t)) + 4 for r, t in own)
        assert w.over_budget == (w.n_tokens > 500)
    assert [len(chat_format.parse_turns(w.text)) for w in windows][0] == 1 and windows[0].n_tokens > 300


# Licenses


def test_license_blocks(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "for a fee").replace("merge, ", "")
    texts = [None, "", "plain prose without any cue", f"intro\n{mit}\nmore prose", f"a\nb\n{changed}\nc", "word " * 2000 + "Released under the MIT License. " + "word " * 2000, "a license to thrill"]
    got = {}
    for r in licenses.scan(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {3, 4, 5, 6}
    assert got[3][0].license == "MIT" and got[3][0].confirmed and got[3][0].same == 1.0
    assert got[4][0].confirmed and {"charge", "merge"} <= set(got[4][0].missing) and "fee" in got[4][0].added
    assert got[5][0].license == "MIT notice" and got[5][0].confirmed
    assert not got[6][0].confirmed
    assert all(texts[d][r.begin : r.end] for d, rs in got.items() for r in rs)
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_is_confirmed_by_wording_whatever_it_saves(spark, monkeypatch):
    """A short line, a notice with few bytes saved, and the last of many templates in rank."""
    cases = ["All rights reserved.", "prose before\nMade by us. All rights reserved.\nprose after"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, cases)).collect()}
    assert all(got[i].license == "All rights reserved" and got[i].confirmed and got[i].same == 1 for i in (0, 1))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rank = scanner.rank
    for name in ("MIT", "Apache-2.0", "MIT notice", "CC-BY-SA-4.0 notice"):
        monkeypatch.setattr(scanner, "rank", lambda block, name=name: sorted(((n, 0.1 if n == name else s) for n, s in rank(block)), key=lambda x: -x[1]))
        found = list(scanner.scan(f"one\n{licenses.TEMPLATES[name]}\ntwo"))
        assert [r[2:4] for r in found] == [(name, True)]


def test_every_license_of_a_block_is_confirmed(spark):
    """Neighbouring notices, a license twice, and one whose lines lie beyond its cue's neighbours."""
    t = licenses.TEMPLATES
    unlicense = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use,\ncompile, sell, or\ndistribute this software, either in source code\nform or as a compiled binary, for any purpose,\ncommercial or non-commercial, and by any means."
    cases = [
        (f"{t['MIT notice']}\n{t['Apache-2.0 notice']}", ["MIT notice", "Apache-2.0 notice"]),
        (f"Copyright (c) X. All rights reserved.\n\n{t['MIT']}\n{t['Apache-2.0']}", ["All rights reserved", "MIT", "Apache-2.0"]),
        ("\n".join([t["MIT notice"]] * 3), ["MIT notice"] * 3),
        (unlicense, ["Unlicense"]),
        ("\n".join(f" * {w}" for w in t["GPL-3.0-or-later"].split(" ")), ["GPL-3.0-or-later"]),
    ]
    rows = licenses.scan(docs(spark, [c for c, _ in cases])).collect()
    for i, (text, want) in enumerate(cases):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.begin)
        assert [r.license for r in own] == want and all(r.confirmed and r.same == 1 and not r.missing for r in own)
        assert all(a.end <= b.begin for a, b in zip(own, own[1:], strict=False)) and own[-1].end <= len(text)


def test_every_noncharacter_in_a_text(spark):
    """A stand-in for U+2581 is found in a text that holds all noncharacters, and comes back as it was."""
    text = "\u2581 a " + "".join(map(chr, range(0xFDD0, 0xFDF0))) + " \u2581b"
    rows = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sentencepieces.segmentations(rows).collect()
    assert all(r.restored for r in got) and len({(r.doc_id, r.sample, bytes(r.ids)) for r in got}) == 6


def test_bytes_stand_for_bare_characters():
    model = sentencepieces.piece_model()
    chars = np.array([0x61, 0x1F600, 0xE9], np.uint32)
    assert model.with_bytes(np.array([7, -1, -1], np.int32), chars).tolist() == [7, *model.byte[list("\U0001F600\u00e9".encode())].tolist()]


def test_each_license_is_told_from_its_kin_however_wrapped(spark):
    """Versions and variants that differ by a word or two, and one that holds another."""
    wide = [(name, textwrap.fill(text, width, break_on_hyphens=False, break_long_words=False)) for name, text in licenses.TEMPLATES.items() for width in (40, 60, 100)]
    found: dict = {}
    for r in licenses.scan(docs(spark, [f"intro\n\n{text}\n\nmore prose" for _, text in wide])).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.confirmed, r.same))
    assert [found.get(i) for i in range(len(wide))] == [[(name, True, 1.0)] for name, _ in wide]


KIN = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 notice"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", None),
    ("This work is licensed under the GNU Library General Public License, version 3.", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0 long notice"),
    ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0 long notice"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0 notice"),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under the EUPL License, Version 2.0.", None),
    (licenses.TEMPLATES["EPL-2.0"].replace("2.0", "1.0"), None),
    (licenses.TEMPLATES["MPL-2.0"].replace("2.0", "1.1"), None),
    (licenses.TEMPLATES["GPL-2.0-or-later"].replace("version 2", "version 3"), "GPL-3.0-or-later"),
    (licenses.TEMPLATES["GPL-2.0-or-later"].replace("General", "Library General"), None),
    (licenses.TEMPLATES["GPL-3.0-or-later"].replace(", or (at your option) any later version", ""), None),
    ("// SPDX-License-Identifier: (GPL-2.0-only OR MIT)\nint x;", "(GPL-2.0-only OR MIT)"),
    ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "Apache-2.0 WITH LLVM-exception"),
]


def test_a_word_that_decides_confirms_no_other_license(spark):
    found: dict = {i: [] for i in range(len(KIN))}
    for r in licenses.scan(docs(spark, [text for text, _ in KIN])).where("confirmed").collect():
        found[r.doc_id].append(r.license)
    assert [found[i] for i in range(len(KIN))] == [[want] if want else [] for _, want in KIN]


def test_alignment_by_brute_force():
    """Least cost of each template in the text of each other one."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, own in scanner.words.items():
        must = licenses.deciding(own)
        for words in scanner.words.values():
            adds = licenses.deciding(words)
            row = [0] * (len(words) + 1)
            for i, w in enumerate(own):
                gone = licenses.DECIDES if must[i] else 1
                inside = must[i] and (i + 1 == len(own) or must[i + 1])
                new = [row[0] + gone]
                for j, x in enumerate(words):
                    add = licenses.DECIDES if inside or adds[j] else 1
                    new.append(min(row[j + 1] + gone, new[j] + add, row[j] if w == x else 1 << 60))
                row = new
            cost, begin, end, same, missing, added = scanner.aligned(words, name)
            assert cost == min(row) and same == 1 - len(missing) / len(own)
            assert end - begin == len(own) - len(missing) + len(added)


def test_license_edge_cases(spark):
    """Very long text, ties, repeated rows, null ids, clashing columns."""
    long = "no cue here. " * 100_000 + "\nReleased under the MIT License.\n" + "x" * 1_000_000
    rows = [(1, long), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (None, "All rights reserved."), (3, None)]
    df = spark.createDataFrame([(i, t, "x", True, 1.0, t) for i, t in rows], "doc_id long, text string, license string, confirmed boolean, saved double, _text string")
    got = sorted(((r.doc_id, r.license, r.confirmed) for r in licenses.scan(df).collect()), key=str)
    assert got == [(1, "MIT notice", True), (2, "MIT notice", True), (2, "MIT notice", True), (None, "All rights reserved", True)]
