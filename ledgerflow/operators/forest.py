"""Isolation forest (Liu, Ting and Zhou 2008): trees on small samples, scored in Arrow batches.

Each tree needs only rows_per_tree rows, so one bounded sample (trees *
rows_per_tree rows at most, chosen by hash of the account) is drawn and the
trees are grown on the driver; scoring is distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


class Forest:
    """Trees as arrays: feature (-1 at leaves), cut, left, right, and the depth credit of leaves."""

    SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"

    def __init__(self, trees: list[tuple[np.ndarray, ...]], rows_per_tree: int):
        self.trees, self.rows_per_tree = trees, rows_per_tree

    def rows(self) -> list[tuple]:
        return [(t, k, int(f[k]), float(c[k]), int(a[k]), int(b[k]), float(d[k])) for t, (f, c, a, b, d) in enumerate(self.trees) for k in range(len(f))]

    @classmethod
    def from_rows(cls, rows, rows_per_tree: int) -> Forest:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["tree"], []).append(r)
        col = lambda t, name, kind: np.array([r[name] for r in t], kind)
        return cls([(col(t, "feature", int), col(t, "cut", float), col(t, "left", int), col(t, "right", int), col(t, "depth", float)) for _, t in sorted(by.items())], rows_per_tree)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean depth / mean_path): near 1 for rows that are isolated early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), int)
            while (live := feature[at] >= 0).any():
                go = rows[live]
                node = at[go]
                at[go] = np.where(x[go, feature[node]] < cut[node], left[node], right[node])
            total += depth[at]
        norm = mean_path(self.rows_per_tree) or 1.0
        return 2.0 ** (-total / max(1, len(self.trees)) / norm)


def _grow(x: np.ndarray, rng: np.random.Generator, most_depth: int) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for a, v in zip((feature, cut, left, right, depth), (-1, 0.0, -1, -1, level + mean_path(len(rows)))):
            a.append(v)
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(high > low)
        if level < most_depth and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            c = float(rng.uniform(low[f], high[f]))
            go = x[rows, f] < c
            if not go.any():
                go = x[rows, f] <= low[f]
                c = float(np.nextafter(low[f], high[f]))
            feature[me], cut[me] = f, c
            left[me] = node(rows[go], level + 1)
            right[me] = node(rows[~go], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return tuple(np.array(a) for a in (feature, cut, left, right, depth))


def fit_forest(x: DataFrame, trees: int = 300, rows_per_tree: int = 256, seed: int = 42) -> Forest:
    """x: account, x (vector)."""
    sample = x.orderBy(F.xxhash64("account", F.lit(seed)), "account").limit(trees * rows_per_tree).select(vector_to_array("x").alias("x")).toPandas()
    rows = np.array(sample["x"].tolist()).reshape(len(sample), -1)
    size, rng = min(rows_per_tree, len(rows)), np.random.default_rng(seed)
    depth = math.ceil(math.log2(max(2, size)))
    return Forest([_grow(rows[rng.choice(len(rows), size, replace=False)], rng, depth) for _ in range(trees if size else 0)], size)


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add anomaly_raw from the vector x, which is dropped."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # trees * 2 * rows_per_tree small nodes

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(x.tolist()).reshape(len(x), -1)) if len(x) else np.zeros(0))

    return df.withColumn("anomaly_raw", raw(vector_to_array("x"))).drop("x")
