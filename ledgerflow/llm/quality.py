"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text
features shared by all grades, and ordered thresholds. Features of a whole
text: its white-space words (lower case), their shapes (runs of capitals,
small letters and digits become one mark, other characters stay), and whether
a word repeats the one before; each family enters as square roots of shares,
so length does not matter. Gives the expected grade and the tail probability
P(grade >= least_grade) for selection.

Learned on at most SAMPLE labelled rows that are not held out. Null and empty
texts have no features and get the thresholds' own probabilities. With fewer
than two grades to learn from, everything has tail probability 1.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample_labelled
from .shared import kept, mapped, small_batches, small_transfers

SAMPLE = 6000
WIDTH = 1 << 15
FAMILIES = (("w", 0.3), ("s", 1.0), ("r", 1.0))
STEPS, RATE, RIDGE = 200, 0.1, 1e-4


def shape(token: str) -> str:
    token = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token)
    return re.sub(r"(\W)\1+", r"\1", re.sub(r"\d+", "0", token))


def hashed(family: str, value: str) -> int:
    return zlib.crc32(f"{family}:{value}".encode("utf-8", "surrogatepass")) % WIDTH


class Features:
    """Sparse rows of texts, with a bounded store of token hashes."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.known) > self.most:
            self.known = {}
        known, n = self.known, len(tokens)
        words, shapes = Counter(), Counter()
        for t, c in Counter(tokens).items():
            if (k := known.get(t)) is None:
                k = known[t] = (hashed("w", t.lower()), hashed("s", shape(t)))
            words[k[0]] += c
            shapes[k[1]] += c
        again = sum(map(str.__eq__, tokens[1:], tokens))
        repeats = {hashed("r", "1"): again, hashed("r", "0"): n - again}
        at, values = [], []
        for (_, weight), found in zip(FAMILIES, (words, shapes, repeats)):
            at.append(np.fromiter(found.keys(), np.int32, len(found)))
            values.append(weight * np.sqrt(np.fromiter(found.values(), np.float32, len(found)) / n))
        return np.concatenate(at), np.concatenate(values)


class Model:
    """grades in order, shared weights, ordered thresholds (one less than grades)."""

    def __init__(self, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= g) for every grade g, a row a margin."""
        tail = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -50, 50)))
        return np.concatenate([np.ones((len(margins), 1)), tail], 1)

    def expected(self, tail: np.ndarray) -> np.ndarray:
        return self.grades[0] + (tail[:, 1:] * np.diff(self.grades)).sum(1)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by Adam on all rows."""
    grades = np.unique(y).astype(float)
    k = len(grades) - 1
    if k < 1:
        return Model(grades if len(grades) else np.zeros(1), np.zeros(WIDTH), np.zeros(0))
    level = np.searchsorted(grades, y)
    at, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]).astype(float)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.array([(level > j).mean() for j in range(k)])
    start = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(start), 1e-3))  # thresholds: the first, then steps exp(gap) up
    p = np.concatenate([np.zeros(WIDTH), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, STEPS + 1):
        steps = np.exp(p[WIDTH + 1 :])
        theta = p[WIDTH] + np.concatenate([[0.0], np.cumsum(steps)])
        margin = np.bincount(owner, value * p[at], len(rows))
        bound = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = logistic(bound[level + 1] - margin), logistic(bound[level] - margin)
        upper[level == k], lower[level == 0] = 1.0, 0.0
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        slope = (du - dl) / len(rows)  # of the negative log likelihood by the margin
        g_theta = np.array([(dl[level == j + 1].sum() - du[level == j].sum()) / len(rows) for j in range(k)])
        g = np.concatenate([np.bincount(at, value * slope[owner], WIDTH) + RIDGE * p[:WIDTH], [g_theta.sum()], [g_theta[j:].sum() * steps[j - 1] for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(grades, p[:WIDTH], p[WIDTH] + np.concatenate([[0.0], np.cumsum(np.exp(p[WIDTH + 1 :]))]))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", grade: str = "quality", most: int = SAMPLE) -> Model:
    def run(batches):
        own = Features()
        for batch in small_batches(batches):
            rows = [own.row(t) for t in batch.column(0).to_pylist()]
            yield {"at": [r[0] for r in rows], "value": [r[1] for r in rows], "y": batch.column(1)}

    found = mapped(sample_labelled(df, labels, grade, most, text, key).select("_text", F.col("_grade").cast("double")), run, "at array<int>, value array<float>, y double").toPandas()
    return fit_rows([(np.asarray(a), np.asarray(b)) for a, b in zip(found["at"], found["value"])], found["y"].to_numpy(float))


def grade(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least_grade: float = 1.0) -> DataFrame:
    """(key, expected_grade, tail_probability) for every row and whole text."""
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # WIDTH weights
    column = int(np.searchsorted(model.grades, least_grade))

    def run(batches):
        model, own = shared.value, kept(token, Features)
        for batch in small_batches(batches):
            rows = [own.row(t) for t in batch.column(1).to_pylist()]
            tail = model.at_least(np.array([float(model.weights[a] @ v) for a, v in rows]))
            above = tail[:, column] if column < tail.shape[1] and tail.shape[1] > 1 else np.full(len(rows), float(tail.shape[1] < 2))
            yield {"_id": batch.column(0), "expected_grade": model.expected(tail), "tail_probability": above}

    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return mapped(rows, run, f"_id {rows.schema[0].dataType.simpleString()}, expected_grade double, tail_probability double").withColumnRenamed("_id", key)


def select_good(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least_grade: float = 1.0, least_probability: float = 0.5) -> DataFrame:
    """The rows of df whose tail probability reaches least_probability, with all their columns; one pass, no join."""
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    column = int(np.searchsorted(model.grades, least_grade))
    at = df.columns.index(text)
    small_transfers(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        model, own = shared.value, kept(token, Features)
        for batch in small_batches(batches):
            rows = [own.row(t) for t in batch.column(at).to_pylist()]
            tail = model.at_least(np.array([float(model.weights[a] @ v) for a, v in rows]))
            if column < tail.shape[1] > 1:
                batch = batch.filter(pa.array(tail[:, column] >= least_probability))
            yield batch

    return df.mapInArrow(run, df.schema)
