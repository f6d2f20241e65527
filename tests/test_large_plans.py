"""Steps whose work must not land in one task, nor be done more than once."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import risk
from ledgerflow.operators import centrality, evaluate


def test_safe_quantile_beyond_one_task(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 5, 11)] + [(None,)], "v double")
    for limit in (100, 0):
        assert risk.safe_quantile(values, "v", 0.95, one_task_rows=limit).first()[0] == pytest.approx(10.1)
    large = risk.safe_quantile(spark.range(5000).select(F.col("id").cast("double").alias("v")), "v", 0.9, one_task_rows=1000)
    assert large.first()[0] == pytest.approx(4499.1)
    assert "percentile" not in large._jdf.queryExecution().executedPlan().toString()


def test_scores_are_joined_once(spark):
    """Confusion, ROC and precision come from one written join, and the last two from one set of running sums."""
    scored = spark.createDataFrame([(f"A{k}", k / 10) for k in range(10)], "account string, risk_score double")
    labels = spark.createDataFrame([(f"A{k}", int(k in (3, 8, 9))) for k in range(10)], "account string, label int")
    m = evaluate.evaluate(scored, labels)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "account" not in plan and plan.count("Window") <= 4
    row, whole = m.first(), evaluate.matched(scored, labels)
    assert row["roc_auc"] == evaluate.roc_auc(whole).first()[0] and row["pr_auc"] == evaluate.average_precision(whole).first()[0]


def test_many_components_in_one_task(monkeypatch):
    """A source costs what its component has: 4,000 components of 10 nodes, all of them sources."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 10, (2, 4000, 25)) + 10 * np.arange(4000)[:, None]
    p = pd.DataFrame({"src": a.ravel(), "dst": b.ravel(), "pivot": True}).drop_duplicates()
    began = time.time()
    got = centrality._dependencies(p).set_index("account")["dependency"].sort_index()
    assert time.time() - began < 8
    few = p[p["src"] < 500]
    monkeypatch.setattr(centrality, "DENSE_NODES", 0)
    again = centrality._dependencies(few).set_index("account")["dependency"].sort_index()
    assert again.max() > 0 and again.to_numpy() == pytest.approx(got.loc[again.index].to_numpy())
