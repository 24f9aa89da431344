"""Operator 11: how filters interact, by inclusion and exclusion.

One aggregate per part holds, for each of the 2^k intersections of the filters,
how many rows fail all filters of it: the sum of the product of their flags. All
figures of every order of the filters follow from these sums:

* survivors of a set of filters, by Möbius inversion over its subsets:
  kept(S) = sum over T in S of (-1)^|T| * joint(T);
* rows that fail exactly a set, by Möbius inversion over its supersets;
* the value of a set, rows that it removes, has the Harsanyi dividends
  (-1)^(|T|+1) * joint(T); a filter's Shapley value is the sum of dividend / |T|
  over the sets that hold it, here times k!, so it stays an integer.

The orders themselves are never run over rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import sha256
from .runtime import table

#: Beyond this many filters the k! orders are too many to list.
MOST_FILTERS = 6


def word_list(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def text_flags(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """Failure flags A to D of each text (null counts as empty), with its digest."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = rows.select(*rows.columns, word_list(F.col("_text")).alias("_words"))
    sized = counted.select(
        *rows.columns, F.size("_words").cast("long").alias("_n"), F.size(F.array_distinct("_words")).cast("long").alias("_distinct"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("_capitals"),
    )
    return sized.select(
        *[c for c in rows.columns if c != "_text"],
        (F.col("_n") < 50).alias("A"),
        (100 * F.col("_distinct") < 65 * F.col("_n")).alias("B"),
        (100 * F.col("_capitals") > 5 * F.length("_text").cast("long")).alias("C"),
        F.col("_text").rlike("[#$%&*|]").alias("D"),
        sha256(F.col("_text")).alias("_digest"),
    )


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (with _id) beside good and toxic as 0 or 1. Rows without an id are
    dealt by digest, so that many of them don't meet in one task."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic")
    )
    lane = F.when(F.col("_id").isNull(), F.xxhash64("_digest").bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    left, right = rows.withColumn("_lane", lane), marks.withColumn("_right_lane", F.lit(0).cast("long"))
    joined = left.join(right, left["_id"].eqNullSafe(right["_label_id"]) & (left["_lane"] == right["_right_lane"]), "left")
    return joined.select(*rows.columns, F.coalesce("_good", F.lit(0)).cast("long").alias("good"), F.coalesce("_toxic", F.lit(0)).cast("long").alias("toxic"))


def copy_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows by part, label and flags, split by E: whether a row of a smaller id has
    the same text. The copies of a text are counted per id, then per part and
    label, before they meet their smallest id, so a hot text stays a few rows. A
    row without an id has no smaller one and is smaller than none."""
    own = ["_digest", "part", "good", "toxic", *flags]
    by_id = rows.groupBy("_id", *own).agg(F.count(F.lit(1)).alias("_n"))
    groups = by_id.groupBy(*own).agg(
        F.sum("_n").alias("_n"), F.min("_id").alias("_first"), F.min_by("_n", "_id").alias("_at_first"),
        F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_no_id"),
    )
    least = groups.groupBy("_digest").agg(F.min("_first").alias("_least"))
    met = groups.join(least, "_digest")
    fresh = F.col("_no_id") + F.when(F.col("_first") == F.col("_least"), F.col("_at_first")).otherwise(0)
    split = F.array(F.struct(F.lit(False).alias("E"), fresh.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("_n") - fresh).alias("n")))
    return met.select("part", "good", "toxic", *flags, F.inline(split)).where("n > 0")


def joint_failures(rows: DataFrame, filters: list[str], weights: dict[str, Column], part: str = "part") -> DataFrame:
    """One row per part: for each weight an array ``<weight>`` whose place m holds
    the weighted count of rows that fail every filter of the bit set m."""
    flag = [F.col(f).cast("long") for f in filters]
    sums, names = [], {}
    for name, weight in weights.items():
        for m in range(1 << len(filters)):
            product = weight
            for i, f in enumerate(flag):
                if m >> i & 1:
                    product = product * f
            names.setdefault(name, []).append(f"_{name}_{m}")
            sums.append(F.sum(product).alias(f"_{name}_{m}"))
    found = rows.groupBy(part).agg(*sums)
    return found.select(part, *(F.array(*columns).alias(name) for name, columns in names.items()))


def _sets(k: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << k) - 1))


def _signed_sum(joint: str, k: int, counts, weight=lambda m: F.lit(1)) -> Column:
    """Sum of (-1)^|m| * weight(m) * joint(m) over the bit sets m that ``counts``."""
    sign = lambda m: F.lit(1) - 2 * (F.bit_count(m) % 2)
    term = lambda m: F.when(counts(m), sign(m) * weight(m) * F.get(F.col(joint), m)).otherwise(F.lit(0))
    return F.aggregate(_sets(k), F.lit(0).cast("long"), lambda total, m: total + term(m).cast("long"))


def survivors(joint: str, k: int) -> Column:
    """Array over bit sets: rows that fail no filter of the set."""
    return F.transform(_sets(k), lambda s: _signed_sum(joint, k, lambda m: m.bitwiseAND(s) == m))


def _bit(i: Column) -> Column:
    return F.pow(F.lit(2), i).cast("int")


def failing_only(joint: str, k: int) -> Column:
    """Array over filters: rows that fail this filter and no other."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: -_signed_sum(joint, k, lambda m: m.bitwiseAND(_bit(i)) != 0))


def shapley(joint: str, k: int) -> Column:
    """Array over filters: k! times the Shapley value of removing rows, from the
    dividends -(-1)^|m| * joint(m), each shared by the |m| filters of its set."""
    share = lambda m: (F.lit(factorial(k)) / F.bit_count(m)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: -_signed_sum(joint, k, lambda m: m.bitwiseAND(_bit(i)) != 0, share))


def interactions(joint: DataFrame, filters: list[str], part: str = "part") -> DataFrame:
    """The report: one row per part, order of the filters and step, from the arrays
    ``rows``, ``good`` and ``toxic`` of :func:`joint_failures`."""
    k = len(filters)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have {factorial(k)} orders; at most {MOST_FILTERS} are reported")
    base = joint.select(
        part, "rows", *(survivors(w, k).alias(f"_{w}_kept") for w in ("rows", "good", "toxic")),
        failing_only("rows", k).alias("_only"), shapley("rows", k).alias("_shapley"),
    )
    steps = []
    for order in permutations(range(k)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"struct('{name}' AS filter_order, {step} AS step, {i} AS f, {before} AS before, {before | 1 << i} AS after)")
            before |= 1 << i
    dealt = base.select("*", F.expr(f"inline(array({', '.join(steps)}))"))
    at = lambda c, i: F.element_at(c, F.col(i) + 1)
    gone = lambda w: at(f"_{w}_kept", "before") - at(f"_{w}_kept", "after")
    failing = F.element_at("rows", F.expr("shiftleft(1, f) + 1"))
    return dealt.select(
        part, "filter_order", "step",
        at("_rows_kept", "after").alias("kept"), gone("rows").alias("removed"), (failing - gone("rows")).alias("redundant"),
        at("_only", "f").alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("_shapley", "f").alias("shapley"),
    )


FILTERS = ["A", "B", "C", "D", "E"]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Report of five text filters over every row and whole text of ``docs``.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z
    > 5 * code points; D: holds any of #$%&*|; E: a row of a smaller id has the
    same text (by SHA-256 of the whole text), in any part, removed or not.

    Null texts count as empty (they fail A, and E where another has a smaller
    id); a null part is the empty string. Rows that repeat an id all count and
    aren't copies of each other; a row without an id never fails E, makes no
    other fail it, and has no label. Of repeated labels of an id the worst and the
    best both count. A part without failures has its rows with zeros; an empty
    table gives no row. Other columns are ignored, whatever their names.
    """
    rows = text_flags(docs, text_col, [F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")])
    counted = copy_counts(with_labels(rows, labels, id_col), FILTERS[:4])
    weights = {"rows": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return interactions(joint_failures(counted, FILTERS, weights), FILTERS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Runs every order over the failure patterns, without inclusion and exclusion.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marked AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
           WHEN 'A' THEN len(d.w) < 50
           WHEN 'B' THEN 100 * len(list_distinct(d.w)) < 65 * len(d.w)
           WHEN 'C' THEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t)
           WHEN 'D' THEN regexp_matches(d.t, '[#$%&*|]')
           ELSE coalesce(d.doc_id > f.least, false) END) AS fails
  FROM d JOIN firsts f ON d.t = f.t LEFT JOIN l ON d.doc_id = l.doc_id),
patterns AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT array_to_string(o, '') AS filter_order, s AS step, o[s] AS f, o[1:s - 1] AS before, o[1:s] AS after FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
report AS (
  SELECT p.part, s.filter_order, s.step, s.f,
         sum(CASE WHEN NOT list_has_any(p.fails, s.after) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN list_contains(p.fails, s.f) AND NOT list_has_any(p.fails, s.before) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_contains(p.fails, s.f) AND list_has_any(p.fails, s.before) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN p.fails = [s.f] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN list_contains(p.fails, s.f) AND NOT list_has_any(p.fails, s.before) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN list_contains(p.fails, s.f) AND NOT list_has_any(p.fails, s.before) THEN toxic ELSE 0 END) AS toxic_lost
  FROM patterns p, steps s GROUP BY p.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM report
"""
