import math

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import flows
from ledgerflow.plans.contract import FEATURE_COLUMNS, FEATURES
from ledgerflow.plans.features import account_features
from ledgerflow.sources import transactions as source

SAMPLE = """Timestamp,From Bank,Account,To Bank,Account.1,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering
9/3/2022 12:18,1,A1,2,A2,10000,NPR,10000,NPR,card,1
9/3/2022 12:20,2,A2,1,A1,10000,NPR,10000,NPR,card,1
9/3/2022 12:20,3,A3,1,A1,10000,NPR,10000,NPR,card,0
"""
D = 2 / 1440
# Worked by hand for the three transactions above: A1, A2, A3.
GOLDEN = {
    "in_degree": (2, 1, 0),
    "out_degree": (1, 1, 1),
    "betweenness_centrality": (0.5, 0, 0),
    "eigenvector_centrality": (0.707125, 0.499987, 0.499987),
    "clustering_coefficient": (0, 0, 0),
    "relay_score": (0, math.exp(-D / 3), 0),
    "local_density": (2 / 3, 0, 0),
    "short_cycle_score": (1, 1, 0),
    "community_size": (3, 3, 3),
    "is_isolated": (0, 0, 0),
    "outgoing_amount_total": (1e4, 1e4, 1e4),
    "outgoing_amount_std": (0, 0, 0),
    "outgoing_concentration": (0.9999999999999,) * 3,
    "outgoing_entropy": (0, 0, 0),
    "incoming_amount_total": (2e4, 1e4, 0),
    "incoming_amount_mean": (1e4, 1e4, 0),
    "unique_in_counterparties": (2, 1, 0),
    "incoming_entropy": (1, 0, 0),
    "incoming_concentration": (0.49999999999997496, 0.9999999999999, 0),
    "max_gap_days": (D, D, 0),
    "mean_gap_days": (D / 2, D, 0),
    "tx_count": (3, 2, 1),
    "velocity_7d": (3, 2, 1),
    "weighted_degree": (3e4, 2e4, 1e4),
    "total_unique_counterparties": (3, 2, 1),
    "in_out_degree_ratio": (1, 0.5, 0),
    "in_out_amount_ratio": (1.9998000199980002, 0.9999000099990001, 0),
    "cashflow_ratio": (1.9998000199980002, 0.9999000099990001, 0),
    "fanout_ratio": (1 / 3, 1 / 2, 1),
    "degree_balance": (1, 0, 1),
    "amount_balance": (1e4, 0, 1e4),
}


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "sample.csv"
    path.write_text(SAMPLE)
    return source.load_transactions(spark, str(path))


def test_sample_goldens(sample):
    out = account_features(sample)
    assert out.columns == ["account", *FEATURE_COLUMNS]
    rows = {r["account"]: r for r in out.collect()}
    for name, values in GOLDEN.items():
        for account, value in zip(("A1", "A2", "A3"), values):
            assert rows[account][name] == pytest.approx(value, abs=1e-6), (name, account)


def test_labels_and_volume(sample):
    assert {tuple(r) for r in flows.account_labels(sample).collect()} == {("A1", 1), ("A2", 1), ("A3", 0)}
    assert [(str(r[0]), r[1]) for r in flows.daily_volume(sample).collect()] == [("2022-09-03", 30000.0)]
    none = sample.withColumn("is_laundering", F.lit(None).cast("int"))
    assert flows.account_labels(none).count() == 0


def test_empty(spark, sample):
    out = account_features(sample.limit(0))
    assert out.schema == FEATURES and out.count() == 0


def test_order_and_partitions_do_not_matter(sample):
    a = sorted(account_features(sample).collect())
    b = sorted(account_features(sample.repartition(3).orderBy(F.desc("tx_id"))).collect())
    assert [r["account"] for r in a] == [r["account"] for r in b]
    for x, y in zip(a, b):
        assert list(x)[1:] == pytest.approx(list(y)[1:])


def test_timing_over_days_and_ties(spark):
    """Windows by day join up: compared with a plain loop over each account's events."""
    import random

    rng = random.Random(5)
    rows = []
    for k in range(400):
        a, b = rng.choice("ABCD"), rng.choice("ABCDE")
        rows.append((k, a, b, rng.choice([0, 3600, 86399, 86400]) + 86400 * rng.randrange(6) + rng.randrange(3)))
    tx = spark.createDataFrame(rows, "tx_id long, from_account string, to_account string, s long").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["account"]: r for r in flows.timing_stats(tx).collect()}
    for account in "ABCDE":
        outs = sorted(s for _, a, _, s in rows if a == account)
        ins = sorted(s for _, _, b, s in rows if b == account)
        line = sorted(outs + ins)
        gaps = [y - x for x, y in zip(line, line[1:])]
        waits = [min(o for o in outs if o >= i) - i for i in ins if any(o >= i for o in outs)]
        assert got[account]["max_gap_days"] == pytest.approx(max(gaps) / 86400)
        assert got[account]["mean_gap_days"] == pytest.approx(sum(gaps) / len(gaps) / 86400)
        assert got[account]["relay_score"] == pytest.approx(math.exp(-sum(waits) / len(waits) / 86400 / 3) if waits else 0.0)
