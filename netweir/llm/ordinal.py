"""Quality as a grade: cumulative-link regression on hashed text.

P(grade >= j) = 1 / (1 + exp(threshold_j - w.x)) with one weight vector w for all grades and ascending
thresholds, so that a text's score places it on one scale and the thresholds cut that scale. Each word gives
three hashed features: the word without its punctuation, its first four bytes, and its shape (capitals,
punctuation at the end). Words and beginnings count as present or not, shapes by their share of the text.

The model is fitted on at most `max_rows` labelled rows, those with the least md5 of their id; the driver
holds these rows' features alone. Scoring reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import map_texts, raw, slices

BITS = 20
PUNCTUATION = b".,;:!?\"'()[]{}#*$%&|<>-_"


class WordFeatures(dict):
    """Three feature numbers of a word in one integer, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        core = word.strip(PUNCTUATION).lower()
        tail = word[len(word.rstrip(PUNCTUATION)):]
        mask, value = (1 << BITS) - 1, 0
        for i, part in enumerate((b"w" + core, b"p" + core[:4], b"s%d" % (word.isupper() and len(core) > 1) + tail[:4])):
            value |= (xxhash.xxh64_intdigest(part, 7) & mask) << (BITS * i)
        self[word] = value
        return value


def features(text: bytes | None, memo: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text; none for null and blank texts."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    mask = np.int64((1 << BITS) - 1)
    present = np.unique(np.concatenate([packed & mask, packed >> BITS & mask]))
    shapes, n = np.unique(packed >> 2 * BITS, return_counts=True)
    return (np.concatenate([present, shapes]).astype(np.int32),
            np.concatenate([np.full(len(present), 0.2), 2 * n / len(words)]).astype(np.float32))


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each grade but the least, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, grade: str, max_rows: int, seed: int) -> DataFrame:
    """(grade, at, value): features of the bounded sample of labelled rows that have a grade and a text."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(grade).cast("double").alias("grade")).where(
        "__id IS NOT NULL AND grade IS NOT NULL").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__id").cast("string"))), "grade").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(chosen, "__id").select("grade", "text")

    def run(batches):
        memo = WordFeatures()
        for batch in slices(batches, 1):
            found = [features(t, memo) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.list_(pa.int32())),
                                              pa.array([v for _, v in found], pa.list_(pa.float32()))], ["grade", "at", "value"])

    return map_texts(rows, run, "grade double, at array<int>, value array<float>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", grade: str = "grade", max_rows: int = 10_000,
        rounds: int = 200,
        rate: float = 1.5, penalty: float = 1e-4, min_rows: int = 5, seed: int = 5) -> OrdinalModel:
    """A model of the grades, by full-batch gradient steps with per-weight scaling and an absolute-value penalty.

    Features of fewer than min_rows rows of the sample have weight 0.
    Rows that repeat an id count each; labels of unknown documents and null grades are left out. With fewer
    than two grades there are no thresholds, and every expected grade is that one (0 without labels).
    """
    found = sample(docs, labels, id_col, text, grade, max_rows, seed).toArrow().combine_chunks()
    y = found["grade"].to_numpy()
    grades, level = np.unique(y, return_inverse=True)
    dim, cuts = 1 << BITS, len(grades) - 1
    w = np.zeros(dim)
    if cuts < 1:
        return OrdinalModel(grades.tolist() or [0.0], w, np.zeros(0))
    lists = [c for c in found["at"].chunks] or []
    at = np.concatenate([c.flatten().to_numpy() for c in lists])
    value = np.concatenate([c.flatten().to_numpy() for c in found["value"].chunks]).astype(np.float64)
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in lists])
    row = np.repeat(np.arange(len(y)), sizes)
    common = (np.bincount(at, minlength=dim) >= min_rows)[at]
    at, value, row = at[common], value[common], row[common]
    share = np.array([(level > j).mean() for j in range(cuts)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    hit = (level[:, None] > np.arange(cuts)).astype(float)
    weight_sum, theta_sum = np.full(dim, 1e-8), np.full(cuts, 1e-8)
    inside = np.abs(level[:, None] - np.arange(cuts) - 0.5) < 1  # only the cuts next to a grade bear on it
    for _ in range(rounds):
        score = np.bincount(row, value * w[at], minlength=len(y))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        # likelihood of a grade: the difference of neighbouring tail probabilities
        upper = np.concatenate([np.ones((len(y), 1)), p], axis=1)[np.arange(len(y)), level]
        lower = np.concatenate([p, np.zeros((len(y), 1))], axis=1)[np.arange(len(y)), level]
        slope = p * (1 - p)
        like = np.maximum(upper - lower, 1e-12)
        sign = np.where(hit > 0, 1.0, -1.0) * inside
        part = sign * slope / like[:, None]  # d log likelihood / d (score - theta_j)
        g_score, g_theta = part.sum(1), -part.sum(0) / len(y)
        g = np.bincount(at, value * g_score[row], minlength=dim) / len(y)
        weight_sum += g * g
        theta_sum += g_theta * g_theta
        step = rate / np.sqrt(weight_sum)
        w += step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = np.sort(theta + rate * g_theta / np.sqrt(theta_sum))
    return OrdinalModel(grades.tolist(), w, theta)


def score(docs: DataFrame, model: OrdinalModel, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, score, expected_grade and tail_probability (of the highest grade) of every document.

    Null and blank texts have score 0. Null and repeated keys stay; other columns are not read.
    """
    rows = docs.select(*keys, F.col(text).alias("__text"))
    schema = rows.select(*keys, *[F.lit(0.0).alias(c) for c in ("score", "expected_grade", "tail_probability")]).schema
    used, grades, size = np.flatnonzero(model.weights), np.array(model.grades), len(model.weights)
    values = model.weights[used]

    def run(batches):
        memo, weights = WordFeatures(), np.zeros(size)
        weights[used] = values
        for batch in slices(batches, len(keys)):
            found = [features(t, memo) for t in raw(batch.column(len(keys)))]
            s = np.array([float(weights[a] @ v) for a, v in found])
            p = model.at_least(s)
            expected = grades[0] + p @ np.diff(grades)
            tail = p[:, -1] if p.shape[1] else np.ones(len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (s, expected, tail))],
                                             [*keys, "score", "expected_grade", "tail_probability"])

    model = OrdinalModel(model.grades, np.zeros(0), model.thresholds)
    return map_texts(rows, run, schema)
