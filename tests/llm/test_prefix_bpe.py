"""Byte-level BPE by prefixes against the tiktoken library, plain merging and round trips."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tallywright.llm import prefix_bpe
from tallywright.llm.wordpieces import DEFAULT, PATTERN

DOCS = "doc_id long, text string, ids string, decoded string, at long, text_sha256 string"


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(seed, n):
    draw = random.Random(seed)
    odd = ["'", "'s", "'re", "'r", "e", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "é", "ß", "中文", "🙂", "👩‍🔬", "²", "1", "42", "½", "_", "-----", "aaaa", "<|endoftext|>", "\x00", "the", "International", "ization"]
    for _ in range(n):
        yield "".join(draw.choice(odd) * draw.choice([1, 1, 1, 2, 7]) for _ in range(draw.randint(0, 30)))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in rows], DOCS)


def test_pieces_equal_library(vocabulary, library):
    for text in [*texts(1, 400), "a" * 5000, " " * 999 + "x", "=" * 700, "ab" * 2000, "é" * 900, "\n" * 300, "0" * 500]:
        assert prefix_bpe.Document(vocabulary, text).ids() == library.encode_ordinary(text)


def test_every_code_point_splits_as_in_library(vocabulary, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = prefix_bpe.Pieces(vocabulary)
    find = prefix_bpe.regex.compile(PATTERN).findall
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c}!{c}{c} b " for c in points[lo : lo + 4096])
        assert [i for p in find(text) for i in words[p]] == library.encode_ordinary(text)


def test_each_prefix_has_one_last_token(vocabulary):
    """The table holds the encodings of all prefixes, and no other token would do."""
    for piece in (" internationalization", "aaaaaaaaaaa", "日本語", "''''re", "  \n\n "):
        raw = piece.encode()
        last = prefix_bpe.array("i")
        vocabulary.extend(last, raw)
        for i in range(1, len(raw) + 1):
            want = [vocabulary.ranks[p] for p in vocabulary.merged(raw[:i])]
            assert vocabulary.read_out(last[:i]) == want
            valid = [t for t in {vocabulary.ranks[raw[j:i]] for j in range(i) if raw[j:i] in vocabulary.ranks} if (b := i - len(vocabulary.tokens[t])) == 0 and vocabulary.fits(t) or b and vocabulary.fits(t, last[b - 1])]
            assert valid == [want[-1]]


def test_pairs_by_their_merges_as_by_definition(vocabulary):
    draw = random.Random(12)
    common = list(vocabulary.tokens)[:900]
    for ids in (common, list(vocabulary.tokens), [t for t in vocabulary.tokens if set(vocabulary.tokens[t]) <= set(b" -=a")]):
        for _ in range(6000):
            a, b = draw.choice(ids), draw.choice(ids)
            assert vocabulary._judged(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [vocabulary.tokens[a], vocabulary.tokens[b]])


def test_tokens_that_merging_does_not_reach():
    """Here `abc` is a token but merging gives a, bc: alone it is itself, inside a piece it can't be used."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 258, b"ab": 257}
    own = prefix_bpe.Vocabulary({k: v for k, v in ranks.items() if k != b"abc"} | {b"abcd": 258})
    library = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("abcd", "xabcd", "abc", "ab", "abab", "abcdabcd", "bcab abcd"):
        assert prefix_bpe.Document(own, text).ids() == library.encode_ordinary(text)
        assert [i for p in prefix_bpe.regex.findall(PATTERN, text) for i in own.encode_piece(p.encode())] == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(vocabulary, library):
    draw = random.Random(9)
    parts = list(texts(3, 60))
    for start in parts[:12]:
        document = prefix_bpe.Document(vocabulary, start)
        for _ in range(25):
            a = draw.randint(0, len(document.text))
            b = draw.choice([a, min(len(document.text), a + draw.randint(0, 6)), len(document.text)])
            if draw.random() < 0.4:
                document.append(draw.choice(parts)[: draw.randint(0, 9)])
            else:
                document.edit(a, b, draw.choice(parts)[: draw.randint(0, 12)])
            fresh = prefix_bpe.Document(vocabulary, document.text)
            assert document.ids() == library.encode_ordinary(document.text)
            assert document.starts == fresh.starts and document.tables == fresh.tables
    with pytest.raises(ValueError):
        document.edit(5, 3, "")


@pytest.mark.parametrize("text", ["plain words in a row " * 5000, "qwertzuiop" * 20_000])
def test_edits_compute_only_what_is_near(vocabulary, library, text):
    document = prefix_bpe.Document(vocabulary, text)
    before = document.computed
    document.edit(len(text) // 2, len(text) // 2 + 3, "xyz1y")
    document.append("tail")
    assert document.ids() == library.encode_ordinary(document.text)
    assert document.computed - before < 1500


def test_rows_equal_library(spark, library):
    """Null and empty texts, null and repeated ids, clashing columns, a very long word and text."""
    rows = [(0, None), (1, ""), (2, "same"), (2, "same"), (None, "no id"), (5, "w" * 300_000), (6, "long text, " * 60_000), *enumerate(texts(5, 40), 10)]
    out = prefix_bpe.decoded(prefix_bpe.encoded(table(spark, rows)))
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    digest = {r.doc_id: r for r in prefix_bpe.digests(out).collect()}
    ids = library.encode_ordinary(rows[6][1])
    assert digest[6].n_tokens == len(ids) and digest[6].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[0].n_tokens == 0 and digest[0].ids_sha256 == digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert prefix_bpe.digests(prefix_bpe.decoded(prefix_bpe.encoded(table(spark, [])))).count() == 0


def test_stored_tables_take_edits(spark, library, tmp_path):
    rows = [*enumerate(texts(6, 20)), (50, None), (51, "tail of a 'r")]
    prefix_bpe.tables(table(spark, rows)).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    after = prefix_bpe.revised(stored.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN length(text) div 2 END AS at", "CAST(NULL AS INT) AS until", "CASE WHEN doc_id <> 3 THEN 'e new' END AS new"))
    got = {r.doc_id: (r.text, list(r.ids)) for r in after.collect()}
    for i, t in rows:
        t, new = t or "", "" if i == 3 else "e new"
        at = len(t) // 2 if i % 2 == 0 else len(t)
        assert got[i] == (t[:at] + new + t[at:], library.encode_ordinary(t[:at] + new + t[at:]))
    assert DEFAULT.endswith(".tiktoken")


def test_query_round_trip(spark):
    import __spark_entry__

    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op13_prefix_bpe"](spark, data).collect()
    assert len(got) == len(docs) and all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in got)


def test_pieces_are_kept_between_tasks(spark):
    """A second task of the same worker learns only what the first one lacked."""
    @F.udf("int")
    def kept(_):
        from tallywright.llm import prefix_bpe

        return len(prefix_bpe.known_pieces())

    one = spark.createDataFrame([(1, "kept between tasks"), (2, " kept  between 12 tasks")], "doc_id long, text string").coalesce(1)
    first, second = (prefix_bpe.encoded(one).orderBy("doc_id").collect() for _ in range(2))
    assert first == second and [r.ids for r in first] == [prefix_bpe.Document(prefix_bpe.vocabulary(), t).ids() for t in ("kept between tasks", " kept  between 12 tasks")]
    assert max(r.n for r in spark.range(0, 64, 1, 16).select(kept("id").alias("n")).collect()) >= 4


def test_many_pieces_at_once_equal_library(vocabulary, library, monkeypatch):
    """New pieces are encoded together, none in a loop of its own; verdicts on pairs may be thrown out at any time."""
    some = list(dict.fromkeys(p for t in texts(8, 600) for p in prefix_bpe.regex.findall(PATTERN, t) if len(p.encode()) <= prefix_bpe.PIECE_BYTES))
    want = [library.encode_ordinary(p) for p in some]
    words = prefix_bpe.Pieces(vocabulary)

    def alone(*args):
        raise AssertionError("a piece was encoded by itself")

    with monkeypatch.context() as m:
        m.setattr(prefix_bpe.Vocabulary, "extend", alone)
        assert words.lists([some[:7], [], some[7:]]).flatten().to_pylist() == [i for x in want for i in x] and words.lists([some]).to_pylist() == [[i for x in want for i in x]]
        m.setattr(prefix_bpe, "PAIRS", 4)
        few = prefix_bpe.Vocabulary(vocabulary.ranks)
        assert few.encode_pieces([p.encode() for p in some])[0].tolist() == [i for x in want for i in x]
    assert [words[p] for p in some] == want and len(words) == len(some)
    assert words.lists([["w" * 99, "a"], [" " * 80]]).to_pylist() == [library.encode_ordinary("w" * 99) + library.encode_ordinary("a"), library.encode_ordinary(" " * 80)]


def test_odd_vocabularies_encode_by_definition():
    """Tokens that no two tokens make, and ranks that don't grow with their parts."""
    draw = random.Random(4)
    for _ in range(60):
        more = list({bytes(draw.choices(b"abc", k=draw.randint(2, 4))) for _ in range(12)})
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(more)}
        small = prefix_bpe.Vocabulary(ranks)
        pairs = [(x, y) for x in [97, 98, 99, *range(256, 256 + len(more))] for y in [97, 98, 99, *range(256, 256 + len(more))]]
        small._prepare()
        before, token = (prefix_bpe.np.array(x, dtype=prefix_bpe.np.int32) for x in zip(*pairs, strict=True))
        assert small._judge(before, token).tolist() == [small._judged(x, y) for x, y in pairs]


def test_decoded_lists(vocabulary):
    lists = prefix_bpe.pa.array([[], [0, 500], None, [50255, 1]], prefix_bpe.pa.list_(prefix_bpe.pa.int32()))
    assert vocabulary.decode_lists(lists).to_pylist() == [vocabulary.decode(x or []) for x in lists.to_pylist()]
    assert vocabulary.decode_lists(lists[1:3]).to_pylist() == [vocabulary.decode([0, 500]), b""] and vocabulary.decode_lists(lists[:1]).to_pylist() == [b""]
    with pytest.raises(KeyError):
        vocabulary.decode_lists(prefix_bpe.pa.array([[-1]], lists.type))
