"""Filter interactions against a run of every order over the rows."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallywright.llm import filter_audit

DOCS = "doc_id long, text string, source string, good long, part string, A boolean, _n long"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(doc_id, text, rows):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        f for f, failing in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * capitals > 5 * len(text), "D": re.search(r"[#$%&*|]", text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }.items() if failing
    }


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marked = [(p or "", i, fails(i, t or "", rows)) for i, t, p in rows]
    out = set()
    for part in {p for p, _, _ in marked}:
        mine = [(i, f) for p, i, f in marked if p == part]
        removed_over_all = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                failing, only = sum(f in x for _, x in mine), sum(x == {f} for _, x in mine)
                removed_over_all[f] += len(gone)
                steps.append((("".join(order)), step, f, len(left), len(gone), failing - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out |= {(part, o, s, *rest, removed_over_all[f]) for o, s, f, *rest in steps}
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 9, "x", True, 5) for i, t, p in rows], DOCS)
    marks = spark.createDataFrame([(i, q, t, "z") for i, q, t in labels], LABELS)
    return filter_audit.audit(docs, marks)


def made(seed):
    draw = random.Random(seed)
    pool = ["plain", "Words", "CAPS", "x#y", "é", "🙂", "a|b", "word", "other", " "]
    texts = [None, "", " \n\t", "ONE", "🙂" * 19 + "A", "🙂" * 20 + "A"]
    for _ in range(25):
        n = draw.choice([3, 49, 50, 51, 120])
        chosen = draw.sample(pool, draw.randint(1, 6))
        texts.append(" ".join(draw.choice(chosen) + (str(draw.randrange(400)) if draw.random() < 0.7 else "") for _ in range(n)))
    rows = [(draw.choice([*range(60), None]), draw.choice(texts), draw.choice(["a", "b", "", None])) for _ in range(90)]
    labels = [(draw.choice([*range(60), None]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(40)]
    return rows, labels


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_every_order_run_over_rows(spark, seed):
    """Repeated and null ids, null texts and parts, repeated labels, copies across parts."""
    rows, labels = made(seed)
    got = run(spark, rows, labels).collect()
    assert {tuple(r) for r in got} == brute(rows, labels) and len(got) == 3 * 600


def test_bounds_of_filters(spark):
    """Just at a bound no filter fails."""
    fifty = " ".join(f"w{i}" for i in range(50))
    sixty_five = " ".join([f"w{i}" for i in range(65)] + ["w0"] * 35)
    rows = [(1, fifty, "s"), (2, sixty_five, "s"), (3, sixty_five + " w0", "s"), (4, fifty + " " + "A" * 9, "s"), (5, "b " * 50 + "c", "s")]
    assert {tuple(r) for r in run(spark, rows, []).collect()} == brute(rows, [])


def test_hot_text_and_very_long_text(spark):
    rows = [(i, "same text", "hot") for i in range(300)] + [(1000, "long " * 200_000, "cold"), (1001, "X" * 500_000, None)]
    assert {tuple(r) for r in run(spark, rows, [(0, 1, 1), (5, 1, 0)]).collect()} == brute(rows, [(0, 1, 1), (5, 1, 0)])


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [], []).dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")]


def test_any_filters_and_their_bound(spark):
    """Joint failures and inversion of three flags; too many are refused."""
    rows = spark.createDataFrame([("p", True, True, False), ("p", True, False, False), ("p", False, False, False)], "part string, x boolean, y boolean, z boolean")
    weights = {"rows": F.lit(1), "good": F.lit(0), "toxic": F.lit(1)}
    joint = filter_audit.joint_failures(rows, ["x", "y", "z"], weights)
    assert joint.first()["rows"] == [3, 2, 1, 1, 0, 0, 0, 0]
    got = {(r.filter_order, r.step): r for r in filter_audit.interactions(joint, ["x", "y", "z"]).collect()}
    assert len(got) == 18 and got["yxz", 2].removed == 1 and got["yxz", 2].redundant == 1 and got["xyz", 1].shapley == 9 and got["xyz", 3].kept == 1
    with pytest.raises(ValueError):
        filter_audit.interactions(joint, list("abcdefg"))
