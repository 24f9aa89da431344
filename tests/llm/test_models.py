"""Classifiers and language models: held-out accuracy and defined cases."""

import os
import random

import numpy as np
import pytest

from tallywright.llm import language_id, lm_scoring, toxicity

random.seed(3)
EN, DE = ["the", "house", "and", "water", "thing", "with", "other"], ["der", "und", "straße", "nicht", "größe", "ein", "schule"]


def text(words, n=30, extra=()):
    out = [random.choice(words) for _ in range(n)]
    for e in extra:
        out.insert(random.randrange(n), e)
    return " ".join(out)


CLASH = "doc_id long, text string, lang string, score double, predicted int, _text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, 0.0, 7, "z") for i, (t, x) in enumerate(rows)], CLASH)


# Language


def test_language_accuracy(spark):
    rows = [(text(EN), "en") if i % 2 else (text(DE), "de") for i in range(120)]
    df = docs(spark, rows)
    model = language_id.fit_from_table(df.where("doc_id < 80"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert len(got) == 120 and all(got[i].lang_pred == rows[i][1] for i in range(80, 120))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    df = docs(spark, [(text(EN), "en"), (text(DE), "de"), (None, "en"), ("", None), ("123 !?", "en"), ("é", None), (text(EN, 30000), "en")])
    model = language_id.fit_from_table(df)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert [got[i] for i in (2, 3, 4)] == ["und"] * 3 and got[6] == "en" and got[5] in ("en", "de")
    assert language_id.predict(df.limit(0), model).count() == 0
    nothing = language_id.fit_from_table(df.where("lang is null"))
    assert nothing is None and {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}


def test_rows_without_id_are_not_held_out(spark, tmp_path):
    rows = [(None if i == 3 else i, text(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (language_id.query, lm_scoring.query):
        got = query(spark, str(tmp_path)).select("doc_id", "held_out").collect()
        assert len(got) == 40 and all(r.held_out in (True, False) for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]


def test_kernel_is_shared_grams_over_mean():
    """Against sets of n-grams; hashing may merge a few."""
    def grams(t):
        padded = "".join(c if c.isalpha() else " " for c in t.lower())
        padded = " ".join(padded.split()) + (" " if not t[-1].isalpha() else "")
        return {padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1)}

    a, b = "The quick brown fox", "the quiet brown box"
    model = language_id.fit([a, b], ["x", "y"])
    matrix = np.concatenate([m for _, m, _ in language_id.presence(*language_id.tk.buffers(language_id.pa.array([a, b])))])
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert model.kernel(matrix)[0, 1] == pytest.approx(want, abs=0.02) and model.kernel(matrix)[0, 0] == pytest.approx(1)


# Toxicity


def test_toxicity_accuracy(spark):
    bad = ["nastyword", "vileword"]
    many = [f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for w in EN for k in range(100)]
    rows = [(text(many, 40, [random.choice(bad)] if i % 4 == 0 else ()), str(int(i % 4 == 0))) for i in range(1500)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(x)) for i, (_, x) in enumerate(rows) if i < 1000], "doc_id long, toxic int")
    model = toxicity.fit_from_tables(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 1500 and sum(got[i].predicted == int(rows[i][1]) for i in range(1000, 1500)) >= 490
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_edge_cases(spark):
    df = docs(spark, [(None, "a"), ("", "a"), ("word", "a"), (text(EN, 20000), "a")])
    empty = toxicity.fit_from_tables(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(df, empty).collect()} == {0}
    assert toxicity.score(df.limit(0), empty).count() == 0
    kept = toxicity.without_toxic(df, empty)
    assert kept.collect() == df.collect() and kept.columns == df.columns


def test_toxicity_ties_repeats_and_null_ids(spark):
    rows = [(i, text(EN, 12, ["nastyword"] if i % 3 == 0 else ())) for i in range(90)]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit_from_tables(df, labels)).collect()
    assert len(got) == 93 and sum(r.doc_id is None for r in got) == 2
    of_first = {r.score for r in got if r.doc_id == 0}
    assert len(of_first) == 1 and of_first <= {r.score for r in got if r.doc_id is None}
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None)


def test_toxicity_is_fitted_in_a_task_in_any_order_of_rows(spark, monkeypatch):
    many = [f"{w}{chr(97 + k % 26)}" for w in EN for k in range(26)]
    rows = [(i, " ".join(many[(i * 37 + j * j) % len(many)] for j in range(40)) + (" nastyword" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")

    driver, fit = os.getpid(), toxicity.fit_nnpu

    def elsewhere(*args):
        assert os.getpid() != driver, "the sample came to the driver"
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit_nnpu", elsewhere)
    one, other = (toxicity.fit_from_tables(x, labels) for x in (df.coalesce(1), df.orderBy(-df.doc_id).repartition(5)))
    assert len(one.features) and one.features.tolist() == other.features.tolist() and one.weights.tolist() == other.weights.tolist() and one.bias == other.bias


def test_risk_and_gradient_equal_brute_force():
    """Against sums over plain sets, and differences of the risk."""
    rng = np.random.default_rng(2)
    names = np.arange(1, 9, dtype=np.uint64)
    sets = [[np.sort(rng.choice(names, rng.integers(1, 6), replace=False)) for _ in range(n)] for n in (7, 15)]
    pos, unl = (toxicity.Presence(x, names) for x in sets)
    w, prior = rng.normal(size=9), 0.3

    def plain(w):
        f = [[sum(w[int(j) - 1] for j in x) + w[-1] for x in kind] for kind in sets]
        loss = lambda values, y: np.mean([np.log1p(np.exp(-y * v)) for v in values])
        return prior * loss(f[0], 1), loss(f[1], -1) - prior * loss(f[0], -1)

    positive, negative, g_pos, g_neg = toxicity.risk(pos, unl, prior, w[:-1], w[-1])
    assert (positive, negative) == pytest.approx(plain(w))
    for j in range(9):
        d = np.zeros(9)
        d[j] = 1e-5
        up, down = plain(w + d), plain(w - d)
        assert (g_pos[j], g_neg[j]) == pytest.approx(((up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5), abs=1e-6)


def test_risk_of_negatives_stays_non_negative():
    """Where the unlabelled texts are all positive, the model doesn't call them negative at any price."""
    import pyarrow as pa

    same = toxicity.feature_sets(pa.array([text(EN, 20, ["cue"]) + f" w{i}" for i in range(60)]))
    model = toxicity.fit_nnpu(same, same, prior=0.5)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias)
    pos = toxicity.Presence(same, model.features)
    assert toxicity.risk(pos, pos, 0.5, model.weights.astype(float), model.bias)[1] > -0.1


# Language models


def test_cross_entropy_difference(spark):
    rows = [(text(EN), "en") if i % 2 else (text(DE), "de") for i in range(200)]
    df = docs(spark, rows + [(None, "x"), ("", "x"), ("e", "x")])
    good = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.fit(df, good)).collect()}
    assert max(got[i].score for i in range(101, 200, 2)) < min(got[i].score for i in range(100, 200, 2))
    assert got[200].score is None and got[201].n_tokens == 0 and got[202].n_tokens == 1


def test_counts_equal_brute_force(spark):
    texts = ["abcdef", None, "ab", "", "zzzzzz" * 50]
    df = spark.createDataFrame([(t, i == 0) for i, t in enumerate(texts)], "text string, good boolean")
    tables = lm_scoring.gather(df, 16)
    chars = sum(len(t or "") for t in texts)
    assert [int(t.sum()) for t in tables] == [chars] * 3 + [6] * 3
    want = np.zeros((256, 256))
    for t in texts:
        for a, b in zip("\0" + (t or ""), t or "", strict=False):
            want[ord(b), ord(a)] += 1
    assert (tables[2].reshape(256, 256) == want).all()
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string"), lm_scoring.Models(16, tables)).count() == 0


@pytest.mark.parametrize("bits", [21, 15])
def test_losses_equal_brute_force_over_many_ngrams(spark, bits):
    """Far more 5-grams than 2**16, in one part and in several."""
    from collections import Counter

    pick = random.Random(5)
    texts = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyzäß ") for _ in range(1500)) for _ in range(120)] + ["the same text again and again " * 40, "", None]
    good = set(range(0, 123, 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame([(t, i in good) for i, t in enumerate(texts)], "text string, good boolean")
    models = lm_scoring.Models(bits, lm_scoring.gather(marked, bits))
    new = [(500, "quite unseen: 12345, the same"), (None, texts[0])]
    rows = list(enumerate(texts)) + new
    got = lm_scoring.score(df.unionByName(spark.createDataFrame(new, df.schema)), models).collect()
    assert len(got) == len(rows) and models.tables.frame.count() > 2 << 16 and (models.tables.parts > 1) == (bits == 15)
    for model in (0, 1):
        counts = Counter()
        for i, t in enumerate(texts):
            raw = b"\0" * 4 + (t or "").encode()
            for j in range(4, len(raw)) if model == 0 or i in good else ():
                for order in range(1, 6):
                    counts[raw[j - order + 1 : j + 1], "all"] += 1
                    counts[raw[j - order + 1 : j], "before"] += 1

        def chance(gram):
            if len(gram) == 1:
                return (counts[gram, "all"] + 1) / (counts[b"", "before"] + 256)
            return (counts[gram, "all"] + 4 * chance(gram[1:])) / (counts[gram[:-1], "before"] + 4)

        def loss(t):
            raw = b"\0" * 4 + t.encode()
            return -sum(np.log(chance(raw[j - 4 : j + 1])) for j in range(4, len(raw))) / (len(raw) - 4)

        by = {(r.doc_id): r["loss_target" if model else "loss_background"] for r in got}
        for i, t in rows[::10] + rows[-5:]:
            assert by[i] == (pytest.approx(loss(t), rel=1e-9) if t else None)
        parts = [models.part(i) for i in range(models.tables.parts)]
        for before in (b"the ", b"abcd", b"\0\0\0\0", b"\xff\xfe\xfd\xfc"):
            every = np.array([int.from_bytes(before + bytes([x]), "little") for x in range(256)], dtype=np.uint64)
            own = parts[int(lm_scoring._dealt(every[:1], len(parts))[0])]
            assert np.exp(-own.losses(every)[model]).sum() == pytest.approx(1, rel=1e-9)


def test_signs_beyond_the_basic_plane_are_no_letters(spark):
    df = docs(spark, [(text(EN), "en"), (text(DE), "de"), ("\U0001F600 \U0001F600", None), ("\U0001F600\U0001F4A9 7", None), ("\U00020000", None)])
    model = language_id.fit_from_table(df)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3)] == [("und", 0.0)] * 2 and got[4].lang_pred != "und"
    pure, mixed = (language_id.presence(*language_id.tk.buffers(language_id.pa.array([t]))) for t in ("the house", "the \U0001F600 house"))
    assert (next(pure)[1] == next(mixed)[1]).all()


def test_every_language_can_be_predicted(spark):
    """More than 64 languages, a rare one, and one of long texts only."""
    words = {f"l{k:02}": ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(75)}
    rows = [(text(own, 12), lang) for lang, own in words.items() for _ in range(6)]
    long, rare = ["qxz", "zxq", "xxqz"], ["äöü", "üöä", "öäü"]
    rows += [(text(long, 7000), "long"), (text(rare), "rare"), (text(long), None), (text(rare), None)]
    df = docs(spark, rows)
    model = language_id.fit_from_table(df)
    assert model.languages == sorted([*words, "long", "rare"])
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert got[len(rows) - 2] == "long" and got[len(rows) - 1] == "rare"
    assert sum(got[i] == lang for i, (_, lang) in enumerate(rows[:-2])) >= len(rows) - 12


def test_toxicity_learns_from_long_texts(spark):
    """All labelled texts are over the mean length that the sample is bounded by."""
    rows = [(text(EN + [f"w{k}" for k in random.sample(range(5000), 300)], 2500, ["vile", "scum", "wretch"] if i % 4 == 0 else ()), None) for i in range(160)]
    assert min(len(t) for t, _ in rows) > toxicity.SAMPLE_CHARS
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit_from_tables(docs(spark, rows), labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, rows), model).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(160)}


def test_toxicity_sample_is_refilled_and_bounded(spark):
    ids = spark.createDataFrame([(i, 50 if i < 4 else 30) for i in range(20)] + [(None, 1), (9, 30)], "doc_id long, chars long")
    short = {r.doc_id for r in toxicity.sampled(ids, 10, 40).collect()}
    assert len(short) in (9, 10) and not short & set(range(4))  # id 9 may be there twice
    every = {r.doc_id for r in toxicity.sampled(ids, 30, 40).collect()}
    assert every == set(range(20))
    assert len({r.doc_id for r in toxicity.sampled(ids.where("chars = 50"), 3, 20).collect()}) == 2  # 60 characters are reached by the second
