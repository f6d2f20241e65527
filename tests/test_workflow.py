"""The whole workflow over CSV files, and plans that must hold for one busy account."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import explain, flows, learning
from ledgerflow.plans import reports, workflow
from ledgerflow.plans.contract import FEATURES, Config
from ledgerflow.sources import transactions

CONFIG = Config(boosting_rounds=5, boosting_depth=3, isolation_trees=30, isolation_rows=32)
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


def lines(seed, n, labelled=True):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for k in range(n):
        a, b = rng.randrange(40), rng.randrange(40)
        bad = a < 6 and b < 12
        t = start + timedelta(minutes=37 * k)
        amount = rng.randrange(100, 900) * (20 if bad else 1) / 4
        out.append(f"{t.month}/{t.day}/{t.year} {t.hour}:{t.minute:02},{a % 3},N{a},{b % 3},N{b},{amount},Euro,{amount},Euro,Wire" + (f",{int(bad)}" if labelled else ""))
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("transactions")
    (folder / "all_trans.csv").write_text(HEADER + "\n".join(lines(1, 900)) + "\n")
    (folder / "new.csv").write_text(HEADER.replace(",Is Laundering", "") + "\n".join(lines(2, 200, labelled=False)) + "\n")
    return folder


@pytest.fixture(scope="module")
def result(spark, files):
    return workflow.run_pipeline(spark, str(files / "all_trans.csv"), CONFIG)


def test_run_pipeline(result):
    assert {k: v.count() for k, v in result.splits.items()} == {"train": 540, "val": 180, "test": 180}
    assert result.features.schema.names == FEATURES.names
    scored = result.scored.collect()
    assert [r["risk_score"] for r in scored] == sorted((r["risk_score"] for r in scored), reverse=True)
    assert len(scored) == result.features.count() and {r["risk_tier"] for r in scored} <= {"Low", "Medium", "High"}
    m = result.metrics.first()
    assert m["roc_auc"] > 0.6 and sum(sum(r) for r in m["confusion_matrix"]) == len(scored)
    table = {r["metric"]: r["value"] for r in reports.metric_table(result.metrics).collect()}
    assert table == {"Precision": m["precision"], "Recall": m["recall"], "F1 Score": m["f1"], "ROC AUC": m["roc_auc"], "PR AUC": m["pr_auc"]}
    cells = {r["actual"]: (r["predicted_non_laundering"], r["predicted_laundering"]) for r in reports.confusion_table(result.metrics).collect()}
    assert cells == {"Actual Non-Laundering": tuple(m["confusion_matrix"][0]), "Actual Laundering": tuple(m["confusion_matrix"][1])}
    assert explain.explain(result.features, result.artifacts, scored[0]["account"])


def test_score_file(spark, files, result, tmp_path):
    learning.save_artifacts(spark, result.artifacts, str(tmp_path / "model"))
    new = workflow.score_file(spark, str(files / "new.csv"), str(tmp_path / "model"), CONFIG)
    assert new.transactions.count() == 200 and new.scored.count() == new.features.count()
    assert new.labels.count() == 0 and new.metrics.count() == 0  # the file has no labels
    again = workflow.score_file(spark, str(files / "all_trans.csv"), str(tmp_path / "model"), CONFIG)
    assert again.metrics.count() == 1


def test_files_on_shared_storage(spark, files):
    found = [f"file:{files}/all_trans.csv", f"file:{files}/new.csv"]
    assert [x.replace("file:///", "file:/") for x in transactions.find_files(f"file://{files}")] == found
    assert transactions.find_files(f"file://{files}/new.csv") == [f"file://{files}/new.csv"]
    assert [transactions.load_transactions(spark, x).count() for x in transactions.find_files(f"file://{files}")] == [900, 200]


def test_busy_account_on_one_day(spark):
    """200,000 events of one account on one day: the windows are linear in them."""
    n = 100_000
    tx = spark.range(n).select(
        F.col("id").alias("tx_id"),
        (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)") / 2)).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("from_account"),
        F.lit("hub").alias("to_account"),
    )
    began = time.time()
    got = flows.timing_stats(tx).where("account = 'hub'").first()
    assert time.time() - began < 30
    # Even events go out too, at the time they come in; odd ones wait half a second, but the last, which nothing follows.
    waits = [0.5 * (k % 2) for k in range(n - 1)]
    assert got["relay_score"] == pytest.approx(2.718281828459045 ** (-sum(waits) / len(waits) / 86400 / 3))
    assert got["max_gap_days"] == pytest.approx(0.5 / 86400)


def test_least_hashed(spark):
    """The cut by digits takes exactly the least rows, whatever the size of the group at the cut."""
    rows = spark.range(3000).withColumn("_h", F.md5(F.col("id").cast("string")))
    order = sorted((r["_h"], r["id"]) for r in rows.collect())
    for wanted, few in ((0, 10), (1, 0), (1234, 0), (1234, 5), (2999, 10_000), (5000, 1)):
        got = learning.least_hashed(rows, wanted, "id", few)
        assert sorted((r["_h"], r["id"]) for r in got.collect()) == order[:wanted]
    same = spark.range(50).withColumn("_h", F.lit("ab" * 16))
    assert sorted(r["id"] for r in learning.least_hashed(same, 20, "id", 0).collect()) == list(range(20))
