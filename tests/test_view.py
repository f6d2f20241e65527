"""The view and its queries leave out no order and no account."""

from collections import defaultdict, deque

import pytest
from conftest import SMALL

from ledgerflow.plans import queries
from ledgerflow.sources import sample_view

MEDIUM = "/root/testdata/sf0.01"


def test_view_reads_every_order(spark):
    orders = {r[0] for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey").collect()}
    got = [r[0] for r in sample_view.transactions(spark, SMALL).select("tx_id").collect()]
    assert set(got) == orders and len(got) == len(orders)


def brandes(edges):
    after, total = defaultdict(list), defaultdict(float)
    nodes = {x for e in edges for x in e}
    for a, b in edges:
        if a != b:
            after[a].append(b)
    for s in nodes:
        depth, paths, above, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in after[u]:
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
                    above[v].append(u)
        delta = defaultdict(float)
        for v in reversed(order[1:]):
            for u in above[v]:
                delta[u] += paths[u] / paths[v] * (1 + delta[v])
            total[v] += delta[v]
    n = len(nodes)
    return {x: total[x] / ((n - 1) * (n - 2)) for x in nodes}


def test_betweenness_exact_covers_all_accounts(spark):
    """Over 1000 accounts, so the operator's default would sample."""
    edges = {tuple(r) for r in sample_view.transactions(spark, MEDIUM).select("from_account", "to_account").collect()}
    want = brandes(edges)
    got = dict(queries.betweenness_exact(spark, MEDIUM).collect())
    assert len(want) > 1000 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
