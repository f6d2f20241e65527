import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerflow.functions import risk
from ledgerflow.operators import evaluate, explain, learning
from ledgerflow.operators.forest import fit_forest, mean_path, score_forest
from ledgerflow.operators.quantiles import quantiles
from ledgerflow.plans import reports
from ledgerflow.plans.contract import Config

CONFIG = Config(boosting_rounds=5, boosting_depth=3, isolation_trees=40, isolation_rows=64)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    x[0] = (9, 9, 9)
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0.8).astype(int)
    rows = [(f"A{k:03}", *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "account string, a double, b double, c double, label int").persist()
    return df.drop("label"), df.select("account", "label")


@pytest.fixture(scope="module")
def trained(table):
    return learning.train_models(*table, CONFIG)


def test_scores(table, trained):
    out = learning.score_accounts(table[0], trained, CONFIG).toPandas().set_index("account")
    assert out["anomaly_score"].idxmax() == "A000" and out["anomaly_score"].max() == 1.0 and out["anomaly_score"].min() == 0.0
    assert np.allclose(out["risk_score"], 0.8 * out["supervised_probability"] + 0.2 * out["anomaly_score"])
    assert trained.threshold_medium <= trained.threshold_high
    assert np.isclose(np.quantile(out["risk_score"], 0.95), trained.threshold_medium)
    same = learning.score_accounts(table[0], trained, CONFIG, scaling="train").toPandas().set_index("account")
    assert np.allclose(same["risk_score"].sort_index(), out["risk_score"].sort_index())
    m = evaluate.evaluate(out.reset_index().pipe(table[0].sparkSession.createDataFrame), table[1]).first()
    assert m["roc_auc"] > 0.9


def test_training_gates(table):
    features, labels = table
    for bad in (None, labels.limit(5), labels.withColumn("label", F.lit(0))):
        got = learning.train_models(features, bad, CONFIG)
        assert got.supervised is None and got.metadata["model_type"] is None
        assert learning.score_accounts(features, got, CONFIG).agg(F.max("risk_score")).first()[0] == pytest.approx(0.2)
        assert explain.explain_shap(features, got).count() == 0


def test_save_and_load(spark, table, trained, tmp_path):
    learning.save_artifacts(spark, trained, str(tmp_path / "model"))
    again = learning.load_artifacts(spark, str(tmp_path / "model"))
    assert again.metadata == trained.metadata and again.feature_columns == trained.feature_columns
    assert sorted(learning.score_accounts(table[0], again, CONFIG).collect()) == sorted(learning.score_accounts(table[0], trained, CONFIG).collect())


def test_shap_adds_up(table, trained):
    rows = explain.shap_values(table[0], trained).collect()
    for r in rows:
        assert sum(r["shap"]) + r["base"] == pytest.approx(r["margin"], abs=1e-9)
    top = explain.explain_shap(table[0], trained, "A000", 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["abs_shap"] >= top[1]["abs_shap"]
    assert explain.explain(table[0], trained, "nobody") == []
    assert len(explain.explain(table[0], trained, "A001", 3)) == 3


def test_shap_brute_force(trained):
    """Against the definition: all coalitions of the leaf games."""
    from itertools import combinations
    from math import factorial

    paths = explain.TreePaths.of(trained.supervised)
    x = np.array([[0.5, -0.2, 1.0]])
    n = 3

    def game(coalition):
        total = 0.0
        for value, conditions in paths.paths:
            for f, low, high, share in conditions:
                value *= float(low < x[0, f] <= high) if f in coalition else share
            total += value
        return total

    want = [sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (game({*s, i}) - game(set(s))) for k in range(n) for s in combinations([j for j in range(n) if j != i], k)) for i in range(n)]
    assert paths.values(x)[0] == pytest.approx(want)


def test_forest(spark):
    assert mean_path(1) == 0 and mean_path(2) == 1
    x = spark.createDataFrame([(str(k), [float(k % 10), float(k // 10)]) for k in range(100)] + [("far", [100.0, 100.0])], "account string, v array<double>").select("account", array_to_vector("v").alias("x"))
    out = score_forest(x, fit_forest(x, 50, 64)).toPandas().set_index("account")["anomaly_raw"]
    assert out.idxmax() == "far" and out.between(0, 1).all()


def test_small_goldens(spark):
    m = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.6, 1), (0.2, 0)], "p double, y int")
    assert evaluate.average_precision(m).first()[0] == pytest.approx(0.7555555555555555)
    assert evaluate.roc_auc(m).first()[0] == pytest.approx(0.7222222222222222)
    assert tuple(evaluate.confusion(m).first()) == (1, 2, 0, 3)
    values = spark.createDataFrame([("k", float(v)) for v in (1, 2, 5, 11)], "key string, value double")
    for limit in (100, 0):
        assert quantiles(values, [0.95, 0.99, 0.5], limit).first()["quantiles"] == pytest.approx([10.1, 10.82, 3.5])


def test_one_class_has_no_metrics(spark):
    scored = spark.createDataFrame([("A", 0.4)], "account string, risk_score double")
    assert evaluate.evaluate(scored, spark.createDataFrame([("A", 1)], "account string, label int")).count() == 0
    assert evaluate.evaluate(scored, spark.createDataFrame([], "account string, label int")).count() == 0


def test_tiers_and_text(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.6,), (0.9,), (None,), (float("nan"),)], "r double")
    assert [x[0] for x in df.select(risk.tier(F.col("r"), 0.5, 0.8)).collect()] == ["Low", "Low", "Medium", "High", "Low", "Low"]
    assert [x[0] for x in df.select(risk.tier(F.col("r"), 0.5, 0.5)).collect()][1:4] == ["Low", "High", "High"]
    one = df.limit(1)
    assert one.select(risk.deviation_text(F.lit("velocity_7d"), F.lit("high"))).first()[0] == "high transaction velocity (high than the portfolio median)"
    assert one.select(risk.contribution_text(F.lit("x"), F.lit(-0.1))).first()[0] == "x decreased the model risk score"
    assert risk.safe_quantile(df.limit(0), "r", 0.5, 7.0).first()[0] == 7.0
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r[0] for r in risk.min_max(flat, "v", "s").select("s").collect()} == {0.0}


def test_reports(spark):
    scored = spark.createDataFrame([("A", 0.1, 0.2, 0.3, "Low"), ("B", 0.1, 0.2, 0.9, "High")], "account string, supervised_probability double, anomaly_score double, risk_score double, risk_tier string")
    assert {tuple(r) for r in reports.tier_counts(scored).collect()} == {("High", 1), ("Medium", 0), ("Low", 1)}
    assert [r["account"] for r in reports.alert_feed(scored).collect()] == ["B", "A"]
    assert [r["account"] for r in reports.alert_feed(scored, "Medium").collect()] == ["B"]
    assert sorted(tuple(r) for r in reports.risk_curve(scored).collect()) == [(0, 0.3), (1, 0.9)]
