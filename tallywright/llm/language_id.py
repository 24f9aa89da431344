"""Operator 6: language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: of the character
n-grams (n = 1 to 4) that occur in each text at all, the number they share over
the geometric mean of their numbers. N-grams are hashed to ``2**DIM_BITS``
places, which is part of the kernel. Nyström landmarks turn it into a linear
map, kernel ridge regression is fitted one-versus-rest, and texts are scored in
batches: presence matrix x landmark matrix x coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import bucket, table

GRAMS, DIM_BITS, BATCH = 4, 15, 32
#: Texts of each language that a model is fitted on, landmarks among them, and the characters read of a text of them.
PER_LANGUAGE, LANDMARKS, SAMPLE_CHARS = 500, 40, 20_000
#: Texts, and landmarks, over all languages, while each language keeps LEAST of either.
TEXTS, POINTS, LEAST = 32_000, 2_560, 4
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, else 0."""
    if not _tables:
        out = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            if chr(i).isalpha():
                low = chr(i).lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def presence(data: np.ndarray, offsets: np.ndarray):
    """Yields (first row, presence matrix, rows with a letter) for groups of at
    most BATCH texts. Anything but a letter separates words."""
    letters, width = _letters(), 1 << DIM_BITS
    weights = tk.mix(np.arange(1, GRAMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for lo, hi in tk.chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        at = heads[offsets[lo : hi + 1] - offsets[lo]]
        codes = letters[codes]
        rows = np.repeat(np.arange(hi - lo), np.diff(at))
        keep = codes != 0
        keep[1:] |= (codes[:-1] != 0) & (rows[1:] == rows[:-1])  # one space after a word
        codes, rows = codes[keep].astype(np.uint64), rows[keep]
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
        hashed = []
        value = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, GRAMS + 1):
            m = max(len(codes) - n + 1, 0)
            value = value[:m] + (codes[n - 1 :] + np.uint64(n)) * weights[n - 1]
            hashed.append((tk.mix(value) >> np.uint64(64 - DIM_BITS)).astype(np.int64))
        for first in range(0, hi - lo, BATCH):
            last = min(first + BATCH, hi - lo)
            matrix = np.zeros((last - first, width), dtype=np.float32)
            flat, begin, end = matrix.reshape(-1), bounds[first], bounds[last]
            for n, h in enumerate(hashed, 1):
                stop = min(end, len(h))
                if stop > begin:
                    inside = rows[begin:stop] == rows[begin + n - 1 : stop + n - 1]
                    flat[((rows[begin:stop] - first) * width + h[begin:stop])[inside]] = 1
            yield lo + first, matrix, np.diff(bounds[first : last + 1]) > 0


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # width x landmarks
    sizes: np.ndarray
    coefficients: np.ndarray  # landmarks x languages

    def kernel(self, matrix: np.ndarray) -> np.ndarray:
        shared = matrix @ self.landmarks
        return shared / np.sqrt(np.maximum(matrix.sum(axis=1), 1)[:, None] * np.maximum(self.sizes, 1))

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        return self.kernel(matrix) @ self.coefficients


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> KernelModel | None:
    """Fit on texts in memory; None if none has a letter. The first
    ``landmarks`` texts of each language are the landmarks."""
    data, offsets = tk.buffers(pa.array(texts, pa.large_string()))
    names, seen, chosen = sorted(set(languages)), dict.fromkeys(languages, 0), []
    for i, lang in enumerate(languages):
        if seen[lang] < landmarks:
            chosen.append(i)
            seen[lang] += 1
    points = np.concatenate([m for _, m, _ in presence(*tk.buffers(pa.array([texts[i] for i in chosen], pa.large_string())))] or [np.zeros((0, 1 << DIM_BITS), np.float32)])
    points = points[points.any(axis=1)]
    if not len(points):
        return None
    model = KernelModel(names, np.ascontiguousarray(points.T), points.sum(axis=1), np.zeros((len(points), len(names)), np.float32))
    gram, found = model.kernel(points).astype(np.float64), []
    for _, matrix, _ in presence(data, offsets):
        found.append(model.kernel(matrix))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate(found).astype(np.float64) @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Each language weighs the same, whatever its share.
    weight = 1.0 / np.array([languages.count(x) for x in names])[[names.index(x) for x in languages]]
    weight *= len(languages) / weight.sum()
    left = mapped.T @ (mapped * weight[:, None]) + ridge * np.eye(mapped.shape[1])
    model.coefficients = (root @ np.linalg.solve(left, mapped.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def fit_from_table(docs: DataFrame) -> KernelModel | None:
    """Fit on about PER_LANGUAGE texts (the first SAMPLE_CHARS characters of
    each) of every value of ``lang`` in ``docs``, chosen by a hash of doc_id; with
    many languages on fewer of each. Rows with a null are left out."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(LEAST, min(PER_LANGUAGE, TEXTS // len(counts)))
    points = max(LEAST, min(LANDMARKS, POINTS // len(counts)))
    # Hashes below the language's bound; enough more that hardly a language gets fewer than it could.
    bounds = [(lang, int((1 << 62) * min(1.0, (1.2 * each + 20) / n))) for lang, n in counts]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, _bound long")
    share = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 62))
    drawn = known.select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text"), "doc_id").join(F.broadcast(bound), "lang").where(share <= F.col("_bound"))
    sample = drawn.select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("h")).collect()
    taken, by = [], {}
    for row in sorted(sample, key=lambda r: (r.h, r.text)):
        by[row.lang] = by.get(row.lang, 0) + 1
        if by[row.lang] <= each:
            taken.append(row)
    return fit([r.text for r in taken], [r.lang for r in taken], points)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred and score (the winner's regression value, from -1..1 to
    0..1). Null texts, and texts without a letter, are ``und`` with score 0.
    Every row, whole texts, null ids and repeated rows too; ties go to the first
    language in order of name; an empty table gives an empty result. Further
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        use = shared.value
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            lang, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            for first, matrix, some in presence(data, offsets) if use else ():
                values = use.scores(matrix)
                best = values.argmax(axis=1)
                rows = first + np.flatnonzero(some)
                lang[rows] = np.array(use.languages, dtype=object)[best[some]]
                score[rows] = ((values.max(axis=1)[some] + 1) / 2).clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 4) == 2
    return predict(docs, fit_from_table(docs.where(~held_out))).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
