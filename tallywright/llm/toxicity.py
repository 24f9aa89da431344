"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, whatever they are, are
unlabelled. A linear classifier on the presence of words and word beginnings is
fitted by the risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) + cost * |weights|

(Kiryo et al. 2017): the second term is the class-prior-corrected risk of the
negatives, which must not fall below zero; where it does, its gradient is
reversed. The last term leaves a feature out unless it lowers the risk by more
than it costs; no list of words and no other test chooses them. Scores are
sigmoids of the linear function over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import bucket, small, table

#: Most texts of each kind that a model is fitted on, and their mean length beyond which fewer are.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED, SAMPLE_CHARS = 2000, 5000, 10_000
#: Bounds of the class prior: a share of zero has no risk, and over the upper one "unlabelled" would mean toxic.
LEAST_PRIOR, MOST_PRIOR = 0.005, 0.6
#: A feature must occur in as many texts of the sample.
SUPPORT = 5
NOISE, ROUNDS, DECAY = 1.2, 4, 1e-4
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6)
HASH_BITS = 22


@dataclass
class PuModel:
    """Sorted feature hashes, a weight for each, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and word beginning; not distinct."""
    data = tk.fold_latin(data)
    starts, ends, rows = tk.word_spans(data, offsets, tk.PUNCTUATION)
    found = [tk.span_hashes(data, starts, ends)]
    for k in BEGINNINGS:
        found.append(tk.mix(tk.span_hashes(data, starts, np.minimum(starts + k, ends)) + np.uint64(k)))
    return np.concatenate(found), np.tile(rows, len(found))


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    data, offsets = tk.buffers(column)
    out: list[np.ndarray] = []
    for lo, hi in tk.chunks(offsets):
        h, rows = feature_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        order = np.argsort(rows, kind="stable")
        out += list(tk.row_sets(h[order], rows[order], hi - lo))
    return out


def _unlike(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Without texts that share their smallest features: one of each group of copies."""
    return list({x[:3].tobytes(): x for x in sets if len(x)}.values())


class Presence:
    """Texts by features, as the places of its ones."""

    def __init__(self, sets: list[np.ndarray], names: np.ndarray):
        found = []
        for x in sets if len(names) else [names] * len(sets):
            j = np.searchsorted(names, x).clip(max=max(len(names) - 1, 0))
            found.append(j[names[j] == x].astype(np.int32))
        self.shape = (len(sets), len(names))
        self.columns = np.concatenate([*found, np.empty(0, np.int32)])
        self.rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in found])

    def only(self, use: np.ndarray) -> Presence:
        out, keep = object.__new__(Presence), use[self.columns]
        out.shape = (self.shape[0], int(use.sum()))
        out.columns, out.rows = (np.cumsum(use) - 1)[self.columns[keep]], self.rows[keep]
        return out

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.shape[0]) + bias

    def back(self, by_row: np.ndarray) -> np.ndarray:
        """Sums per feature, and of all rows."""
        return np.append(np.bincount(self.columns, by_row[self.rows], self.shape[1]), by_row.sum())


def risk(pos: Presence, unl: Presence, prior: float, weights: np.ndarray, bias: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of positives and corrected risk of negatives, by logistic loss
    (-log s for label +1, -log(1 - s) for -1), and the gradient of each."""
    fp, fu = pos.margins(weights, bias), unl.margins(weights, bias)
    sp, su = (1 / (1 + np.exp(-f.clip(-60, 60))) for f in (fp, fu))
    positive = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return positive, negative, pos.back(prior * (sp - 1) / len(sp)), unl.back(su / len(su)) - pos.back(prior * sp / len(sp))


def _descend(pos: Presence, unl: Presence, prior: float, w: np.ndarray, steps: int, rate: float, cost: np.ndarray, decay: float = 0.0) -> np.ndarray:
    """Weights and bias from ``w`` on, by Adam with a proximal step for the cost of weights."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, g_pos, g_neg = risk(pos, unl, prior, w[:-1], w[-1])
        grad = g_pos + g_neg if negative >= 0 else -g_neg
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (1 - 0.9 * t / steps) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * cost, 0)
    return w


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 60, rate: float = 0.1, noise: float = NOISE, support: int = SUPPORT) -> PuModel:
    """Fit on the feature sets of two samples. Order and repeats don't matter
    much, since near copies count once. Without positives or unlabelled texts
    every text gets a score below 0.5.

    The cost of a weight is the gradient that chance alone gives to some feature
    of that frequency: ``noise * prior * sqrt(log(features) * share / positives)``.
    Features come in when their gradient exceeds it, and leave at weight zero, so
    that most never take part. Those chosen are fitted again without the cost."""
    pos, unl = _unlike(positive), _unlike(unlabelled)
    if not pos or not unl:
        return PuModel(np.empty(0, np.uint64), np.empty(0, np.float32), -4.0, prior)
    every = np.sort(np.concatenate(pos + unl))
    least = min(support, len(pos) // 8 + 1)
    names = np.unique(every[least - 1 :][every[least - 1 :] == every[: len(every) - least + 1]])
    del every
    xp, xu = Presence(pos, names), Presence(unl, names)
    w = np.append(np.zeros(len(names)), np.log(prior / (1 - prior)))
    use = np.zeros(len(names), dtype=bool)
    share = (np.bincount(xu.columns, minlength=len(names)) + 1) / (len(unl) + 1)
    cost = noise * prior * np.sqrt(np.log(len(names) + 1) * share / len(pos))
    for _ in range(ROUNDS):
        _, _, g_pos, g_neg = risk(xp, xu, prior, w[:-1], w[-1])
        more = ~use & (np.abs(g_pos + g_neg)[:-1] > cost)
        if not more.any():
            break
        use |= more
        at = np.append(use, True)
        w[at] = _descend(xp.only(use), xu.only(use), prior, w[at], steps, rate, cost[use])
        use &= w[:-1] != 0
    at = np.append(use, True)
    w[at] = _descend(xp.only(use), xu.only(use), prior, w[at], 4 * steps, rate, 0 * cost[use], DECAY)
    chosen = w[:-1] != 0
    return PuModel(names[chosen], w[:-1][chosen].astype(np.float32), float(w[-1]), prior)


def sampled(ids: DataFrame, rows: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` of ``ids`` (doc_id, chars) in the order of a hash of the
    id, texts of up to ``chars`` characters first. The rest is filled up with
    longer ones, whole, until ``rows * chars`` characters are reached; the text
    that reaches them is the last."""
    order = [F.col("chars") > chars, F.xxhash64("doc_id", F.lit(10)), F.col("doc_id"), F.col("chars")]
    first = ids.where(F.col("doc_id").isNotNull()).orderBy(*order).limit(rows)
    before = F.sum("chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # of at most ``rows`` rows
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < rows * chars).select("doc_id").distinct()


def fit_from_tables(docs: DataFrame, labels: DataFrame) -> PuModel:
    """Fit on a bounded sample (``sampled``): at most SAMPLE_POSITIVE texts that
    ``labels`` marks toxic and SAMPLE_UNLABELLED others, of SAMPLE_CHARS
    characters in the mean. ``labels`` must hold only
    the rows that may be learnt from; the prior is the share of toxic ones
    among them, but no less than LEAST_PRIOR and no more than MOST_PRIOR. Rows with a null id or mark are left out. Tasks make the feature
    sets and one of them fits on the sample's; only the model comes to the driver."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    share = marks.agg(F.avg("toxic")).first()[0]
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, share or 0.0))
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    toxic = sampled(sizes.join(small(marks.where("toxic = 1").select("doc_id").distinct()), "doc_id", "left_semi"), SAMPLE_POSITIVE)
    other = sampled(sizes.where(bucket(F.col("doc_id"), 5) != 0), SAMPLE_UNLABELLED)
    sample = toxic.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def sets(batches):
        for batch in batches:
            found = pa.array([x.tobytes() for x in feature_sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), found], names=["doc_id", "positive", "features"])

    def fit(batches):
        found: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for batch in batches:
            for kind, x in zip(batch.column("positive").to_pylist(), batch.column("features"), strict=True):
                found[kind].append(np.frombuffer(x.as_buffer(), np.uint64))
        model = fit_nnpu(found[True], found[False], prior)
        yield pa.RecordBatch.from_pydict({"features": [model.features.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})

    rows = texts.select("doc_id", "positive", "text").mapInArrow(tk.tidy(sets), "doc_id long, positive boolean, features binary")
    fitted = rows.repartition(1).sortWithinPartitions("doc_id", "positive", "features").mapInArrow(tk.tidy(fit), "features binary, weights binary, bias double").first()
    if fitted is None:
        return fit_nnpu([], [], prior)
    return PuModel(np.frombuffer(fitted.features, np.uint64), np.frombuffer(fitted.weights, np.float32), fitted.bias, prior)


class Scorer:
    def __init__(self, model: PuModel):
        self.model = model
        self.mask = np.uint64((1 << HASH_BITS) - 1)
        self.hit = np.zeros(1 << HASH_BITS, dtype=bool)
        self.hit[(model.features & self.mask).astype(np.int64)] = True

    def __call__(self, column: pa.Array) -> np.ndarray:
        names, total = self.model.features, np.full(len(column), self.model.bias)
        data, offsets = tk.buffers(column)
        for lo, hi in tk.chunks(offsets) if len(names) else ():
            h, rows = feature_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            near = self.hit[(h & self.mask).astype(np.int64)]
            h, rows = h[near], rows[near]
            j = np.searchsorted(names, h).clip(max=len(names) - 1)
            same = names[j] == h
            pairs = np.unique(rows[same] * len(names) + j[same])  # presence, not counts
            np.add.at(total, lo + pairs // len(names), self.model.weights[pairs % len(names)])
        return 1 / (1 + np.exp(-total.clip(-60, 60)))


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id, score and predicted for every row and its whole text. Null and
    empty texts have no feature and get the score of the bias; repeated rows and
    null ids are scored each, equal texts alike; an empty table gives an empty result. Further
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            out = scorer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidy(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: PuModel) -> DataFrame:
    """The rows of ``docs`` that score under THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(tk.tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_from_tables(docs, labels.where(bucket(F.col("doc_id"), 5) != 0))
    return score(docs, model).withColumn("held_out", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)))
