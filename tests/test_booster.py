"""The booster grown by one stage: against Spark's, over several tasks, and without jobs a round."""

import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ledgerflow.operators import explain
from ledgerflow.operators.booster import Booster, best_splits, fit_booster
from ledgerflow.operators.explain import TreePaths


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)) * 4)  # few values, so that both boosters cut between all of them
    y = (x[:, 0] + x[:, 1] * x[:, 2] / 4 + rng.normal(size=600) > 2).astype(int)
    rows = [(f"A{k:03}", v.tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "account string, a array<double>, label int").select("account", array_to_vector("a").alias("x"), "label").persist()


def fit(labelled, rounds=6, task_rows=1000, share=1.0):
    return fit_booster(labelled, 4, 600, 2.5, rounds, 3, 0.05, 42, task_rows, share)


def test_spark_grows_the_same(labelled):
    weighted = labelled.withColumn("weight", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=6, maxDepth=3, stepSize=0.05).fit(weighted)
    rows = model.transform(labelled).select(vector_to_array("x").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    got = fit(labelled).margins(np.array([r["x"] for r in rows]))
    assert 1 / (1 + np.exp(-2 * got)) == pytest.approx(np.array([r["p"] for r in rows]), abs=1e-9)


def test_tasks_grow_one_model(labelled):
    one, many = fit(labelled, share=0.8), fit(labelled, task_rows=150, share=0.8)  # one task, and four in a barrier stage
    assert len(one.trees) == len(many.trees) == 6
    for a, b in zip(one.trees, many.trees):
        assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_rounds_are_no_jobs(spark, labelled):
    """Spark's booster ran some seven jobs a round."""

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        fit(labelled, rounds)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    assert jobs(3) == jobs(40) < 20


def test_many_leaves_explained_in_bulk():
    """The shares of 100 whole trees of depth 6 for 4,000 rows; leaf by leaf with products over the rows this took minutes."""
    rng = np.random.default_rng(5)
    inner = 63
    trees = []
    for _ in range(100):
        feature = np.r_[rng.integers(0, 12, inner), np.full(64, -1)]
        below = 2 * np.arange(127) + 1
        weight = np.ones(127)
        for k in reversed(range(inner)):
            weight[k] = weight[2 * k + 1] + weight[2 * k + 2]
        trees.append((feature, rng.normal(size=127), np.where(feature >= 0, below, -1), np.where(feature >= 0, below + 1, -1), rng.normal(size=127), weight))
    model, x = Booster(trees), rng.normal(size=(4000, 12))
    paths = TreePaths.of(model)
    began = time.time()
    got = paths.values(x)
    assert time.time() - began < 20
    assert got.sum(1) + paths.base == pytest.approx(model.margins(x))


def test_pure_nodes_are_leaves():
    sums = np.zeros((1, 2, 1, 32))
    sums[0, 0, 0, :2], sums[0, 1, 0, :2] = (3, 4), (0.3, 0.4)  # the same target on both sides
    assert best_splits(sums, np.ones((1, 1), bool))[0].tolist() == [-1]
    sums[0, 1, 0, 0] = 0.9
    assert best_splits(sums, np.ones((1, 1), bool))[0].tolist() == [0]


def test_long_paths_by_rows(labelled, monkeypatch):
    model = fit(labelled)
    x = np.array([r["x"].toArray() for r in labelled.limit(50).collect()])
    tabled = TreePaths.of(model)
    monkeypatch.setattr(explain, "MOST_BITS", 0)
    long = TreePaths.of(model)
    assert tabled.tables and not tabled.rest and long.rest
    assert long.values(x) == pytest.approx(tabled.values(x))
