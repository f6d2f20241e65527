"""Why an account stands out: deviation from the portfolio, and Shapley values of the boosted model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import contribution_text, deviation_text
from .booster import Booster
from .learning import Artifacts, prepared
from .quantiles import quantiles


def unpivot(features: DataFrame) -> DataFrame:
    """account, feature, value for every numeric column."""
    columns = [c for c in features.columns if c != "account"]
    return features.select("account", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("account", columns, "feature", "value")


def deviations(features: DataFrame) -> DataFrame:
    """feature, median, mad: the median absolute deviation, 1e-9 where it is 0."""
    rows = unpivot(features).select(F.col("feature").alias("key"), "value")
    middle = quantiles(rows, [0.5]).select("key", F.col("quantiles")[0].alias("median"))
    off = rows.join(F.broadcast(middle), "key").select("key", F.abs(F.col("value") - F.col("median")).alias("value"))
    spread = quantiles(off, [0.5]).select("key", F.col("quantiles")[0].alias("mad"))
    return middle.join(spread, "key").select(F.col("key").alias("feature"), "median", F.when(F.col("mad") == 0, F.lit(1e-9)).otherwise(F.col("mad")).alias("mad"))


def _top(rows: DataFrame, top_k: int) -> DataFrame:
    """account, rank and the fields of the top_k least entries of the array _each, ordered by its _k and feature; entries without a _k come last."""
    last = F.transform("_each", lambda x: x.withField("_k", F.coalesce(x["_k"], F.lit(float("inf")))))
    found = rows.select("account", F.posexplode(F.slice(F.array_sort(last), 1, top_k)).alias("_at", "_x"))
    return found.select("account", (F.col("_at") + 1).alias("rank"), "_x.*").drop("_k")


def explain_deviation(features: DataFrame, accounts: DataFrame | str | None = None, top_k: int = 5) -> DataFrame:
    """account, rank, feature, direction, value, median, deviation, reason: the top_k strongest robust z-scores of each asked account (all accounts by default); unknown accounts have no rows."""
    asked = features
    if isinstance(accounts, str):
        asked = features.where(F.col("account") == accounts)
    elif accounts is not None:
        asked = features.join(accounts.select("account"), "account", "left_semi")
    columns = [c for c in features.columns if c != "account"]
    # One row: the middle and spread of every feature. An account's features are ranked inside its row, so accounts are never shuffled.
    spreads = deviations(features).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "mad")))).alias("_of"))
    value, of = lambda c: F.col(c).cast("double"), lambda c, x: F.col("_of")[c][x]
    score = lambda c: F.abs((value(c) - of(c, "median")) / of(c, "mad"))
    each = F.array(*[F.struct((-score(c)).alias("_k"), F.lit(c).alias("feature"), value(c).alias("value"), of(c, "median").alias("median"), score(c).alias("deviation")) for c in columns])
    rows = _top(asked.crossJoin(F.broadcast(spreads)).select("account", each.alias("_each")), top_k)
    rows = rows.withColumn("direction", F.when(F.col("value") >= F.col("median"), "high").otherwise("low"))
    return rows.select("account", "rank", "feature", "direction", "value", "median", "deviation", deviation_text(F.col("feature"), F.col("direction")).alias("reason"))


# ---- Shapley values


ROWS = 4096  # a batch of rows whose columns stay in the processor's cache
MOST_BITS = 11  # splits whose outcomes are tabled together


class TreePaths:
    """Every leaf of every tree as the conditions on its path, by feature: bounds, and the share of training weight that follows the path at the feature's splits."""

    def __init__(self, paths: list[tuple[float, list[tuple[int, float, float, float]]]], base: float):
        self.paths, self.base = paths, base
        self.tables: list[tuple[list[tuple[int, float]], list[int], np.ndarray]] = []
        self.rest: list[int] = []

    @classmethod
    def of(cls, model: Booster) -> TreePaths:
        paths, base, blocks = [], 0.0, []
        for tree in model.trees:
            for leaves in _blocks(tree):
                blocks.append((len(paths), leaves))
                for value, cover, path in leaves:
                    paths.append((value, _merged(path)))
                    base += value * cover
        out = cls(paths, base)
        out._tabulate(blocks)
        return out

    def _tabulate(self, blocks) -> None:
        """tables: for the leaves of a small subtree, the splits on their paths, the features, and what each feature gets in each of the 2 ** splits outcomes (bit i: the row goes right at split i). rest: leaves with too many splits for that."""
        shares = self.shares()
        for first, leaves in blocks:
            splits = list(dict.fromkeys((f, cut) for _, _, path in leaves for f, cut, _, _ in path))
            if len(splits) > MOST_BITS:
                self.rest += range(first, first + len(leaves))
                continue
            cases = np.arange(2 ** len(splits))
            right = {split: cases >> i & 1 == 1 for i, split in enumerate(splits)}
            features = list(dict.fromkeys(f for f, _ in splits))
            table = np.zeros((len(features), len(cases)))
            for k, (_, _, path) in enumerate(leaves, first):
                place = {f: i for i, (f, _, _, _) in enumerate(self.paths[k][1])}
                passed = np.ones((len(place), len(cases)), bool)
                for f, cut, goes, _ in path:
                    passed[place[f]] &= right[f, cut] == goes
                case = (passed << np.arange(len(place))[:, None]).sum(0, dtype=np.intp)
                for f, i in place.items():
                    table[features.index(f)] += shares[k][i].take(case)
            if features:
                self.tables.append((splits, features, table))

    def shares(self) -> list[np.ndarray]:
        """Of each leaf, what each of its m features gets in each of the 2 ** m cases of conditions that a row passes: (feature, case), case having bit i where condition i is passed.

        A leaf's game over its path's features multiplies, for each feature,
        1 or 0 (the row passes its conditions) inside a coalition and the
        cover share outside. Coalitions are summed by size with one polynomial
        product a leaf, so this is exact and polynomial in the path length.
        All leaves of as many features are worked out together.
        """
        out: list = [np.zeros((0, 1))] * len(self.paths)
        by: dict[int, list[int]] = {}
        for k, (_, conditions) in enumerate(self.paths):
            if len(conditions) <= MOST_BITS:
                by.setdefault(len(conditions), []).append(k)
        for m, every in by.items():
            inside = (np.arange(2**m)[None, :] >> np.arange(m)[:, None] & 1).astype(float)
            weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
            for some in (every[k : k + 1024] for k in range(0, len(every) if m else 0, 1024)):
                share = np.array([[c[3] for c in self.paths[k][1]] for k in some])
                value = np.array([self.paths[k][0] for k in some])
                table = np.empty((len(some), m, 2**m))
                for i in range(m):
                    poly = np.zeros((len(some), 2**m, m))
                    poly[:, :, 0] = 1.0
                    for j in range(m):
                        if j != i:
                            shifted = np.zeros_like(poly)
                            shifted[:, :, 1:] = poly[:, :, :-1] * inside[j][None, :, None]
                            poly = poly * share[:, j, None, None] + shifted
                    table[:, i] = value[:, None] * (inside[i][None, :] - share[:, i, None]) * (poly @ weights)
                for k, t in zip(some, table):
                    out[k] = t
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the margin, a row a row of x, looked up by the outcomes of the splits."""
        out = np.zeros((x.shape[1], len(x)))
        for start in range(0, len(x), ROWS):
            part = np.ascontiguousarray(x[start : start + ROWS].T)
            to, right = out[:, start : start + ROWS], {}
            for splits, features, table in self.tables:
                case = np.zeros(part.shape[1], np.uint16)
                for i, (f, cut) in enumerate(splits):
                    goes = right.get((f, cut))
                    if goes is None:
                        goes = right[f, cut] = (part[f] > cut).astype(np.uint16)
                    case |= goes << i
                case = case.astype(np.intp)
                for f, gets in zip(features, table):
                    to[f] += gets.take(case, mode="clip")
        for k in self.rest:
            self._by_rows(x, *self.paths[k], out)
        return out.T

    @staticmethod
    def _by_rows(x: np.ndarray, value: float, conditions, out: np.ndarray) -> None:
        """The same for one leaf, with the products over the rows."""
        m = len(conditions)
        inside = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in conditions], 1).astype(float)
        weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for i in range(m):
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    shifted = np.zeros_like(poly)
                    shifted[:, 1:] = poly[:, :-1] * inside[:, j : j + 1]
                    poly = poly * conditions[j][3] + shifted
            out[conditions[i][0]] += value * (inside[:, i] - conditions[i][3]) * (poly @ weights)


def _merged(path) -> list[tuple[int, float, float, float]]:
    """The conditions of a path of (feature, cut, goes right, share), by feature."""
    merged: dict[int, list[float]] = {}
    for f, cut, right, share in path:
        low, high, before = merged.setdefault(f, [-math.inf, math.inf, 1.0])
        merged[f] = [max(low, cut) if right else low, high if right else min(high, cut), before * share]
    return [(f, *v) for f, v in merged.items()]


def _blocks(tree: tuple[np.ndarray, ...]) -> list[list]:
    """A tree's leaves as (value, cover share, path of (feature, cut, goes right, share)), in lists of those below one node of height 2, or less where there are no more."""
    feature, cut, left, right, value, weight = (a.tolist() for a in tree)
    blocks: list[list] = []

    def walk(node, cover, path):
        """The leaves below, and the height."""
        if feature[node] < 0:
            return [(value[node], cover, path)], 0
        below = []
        for child, goes in ((left[node], False), (right[node], True)):
            share = weight[child] / weight[node] if weight[node] else 0.5
            below.append(walk(child, cover * share, [*path, (feature[node], cut[node], goes, share)]))
        height = max(h for _, h in below) + 1
        if height <= 2:
            return below[0][0] + below[1][0], height
        blocks.extend(leaves for leaves, h in below if h <= 2)
        return [], height

    leaves, height = walk(0, 1.0, [])
    return [*blocks, leaves] if height <= 2 else blocks


def shap_values(features: DataFrame, artifacts: Artifacts) -> DataFrame:
    """account, shap (array in feature order), base, margin of every row: the sum of shap and base is the margin of the vector that the model sees."""
    paths = TreePaths.of(artifacts.supervised)
    shared = features.sparkSession.sparkContext.broadcast((paths, artifacts.supervised))  # some 40 MB for 300 trees of depth 6

    @F.pandas_udf("shap array<double>, margin double")
    def values(x: pd.Series) -> pd.DataFrame:
        leaves, model = shared.value
        rows = np.array(x.tolist()).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
        return pd.DataFrame({"shap": list(leaves.values(rows)) if len(x) else [], "margin": model.margins(rows)})

    rows = prepared(features, artifacts).select("account", values(vector_to_array("x")).alias("_v"))
    return rows.select("account", "_v.shap", F.lit(paths.base).alias("base"), "_v.margin")


def explain_shap(features: DataFrame, artifacts: Artifacts, accounts: DataFrame | str | None = None, top_k: int = 7) -> DataFrame:
    """account, rank, feature, shap_value, abs_shap, reason of the asked accounts; no supervised model or unknown accounts: no rows."""
    schema = "account string, rank int, feature string, shap_value double, abs_shap double, reason string"
    if artifacts.supervised is None:
        return features.sparkSession.createDataFrame([], schema)
    asked = features
    if isinstance(accounts, str):
        asked = features.where(F.col("account") == accounts)
    elif accounts is not None:
        asked = features.join(accounts.select("account"), "account", "left_semi")
    names = F.array(*[F.lit(c) for c in artifacts.feature_columns])
    each = F.zip_with(names, "shap", lambda n, v: F.struct((-F.abs(v)).alias("_k"), n.alias("feature"), v.alias("shap_value"), F.abs(v).alias("abs_shap")))
    rows = _top(shap_values(asked, artifacts).select("account", each.alias("_each")), top_k)
    return rows.select("account", "rank", "feature", "shap_value", "abs_shap", contribution_text(F.col("feature"), F.col("shap_value")).alias("reason"))


def explain(features: DataFrame, artifacts: Artifacts, account: str, top_k: int = 7) -> list[str]:
    """Sentences for one account: Shapley reasons, or deviations where there are none."""
    for rows in (explain_shap(features, artifacts, account, top_k), explain_deviation(features, account, top_k)):
        found = [r["reason"] for r in rows.orderBy("rank").select("reason").collect()]
        if found:
            return found
    return []
