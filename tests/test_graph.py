import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import centrality, communities, components, graph
from ledgerflow.operators.tables import numbered


def random_edges(seed, n=24, m=45):
    rng = random.Random(seed)
    return sorted({(f"N{rng.randrange(n):02}", f"N{rng.randrange(n):02}") for _ in range(m)})


@pytest.fixture(params=[1, 2])
def pairs(request):
    return random_edges(request.param)


@pytest.fixture
def e(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture
def order(spark, pairs):
    nodes = sorted({x for p in pairs for x in p})
    return spark.createDataFrame(list(zip(nodes, range(len(nodes)))), "account string, node_idx long")


def reachable(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in pairs:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    return reach


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    assert sorted((r["at"], r["k"]) for r in numbered(df, ["k"], "at").collect()) == [(i, i) for i in range(101)]


def test_components(e, pairs):
    both = reachable(pairs + [(b, a) for a, b in pairs])
    got = {r["account"]: r["component"] for r in components.weak_components(e).collect()}
    assert got == {v: min(r) for v, r in both.items()}


@pytest.mark.parametrize("task_edges", [2_000_000, 0])
def test_strong_components(e, pairs, task_edges):
    reach = reachable(pairs)
    want = {v: sum(v in reach[u] for u in reach[v]) - 1.0 for v in reach}
    assert {r["account"]: r["short_cycle_score"] for r in components.short_cycle_scores(e, task_edges).collect()} == want


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


@pytest.mark.parametrize("cutoff", [100, 3])
def test_neighbourhoods(e, order, pairs, cutoff):
    near = neighbours(pairs)
    linked = {frozenset(p) for p in pairs}
    got = {r["account"]: r for r in graph.neighbourhoods(e, order, cutoff).collect()}
    for v, around in near.items():
        others = around - {v}
        d = len(others)
        t = sum(frozenset(p) in linked for p in itertools.combinations(others, 2))
        clustering = 2 * t / (d * (d - 1)) if d > 1 else 0.0
        inside = others | {v}
        k = len(inside)
        edges = sum(p <= inside for p in linked)
        density = edges / max(k * (k - 1) / 2, 1) if 1 < len(around) <= cutoff else clustering
        assert got[v]["clustering_coefficient"] == pytest.approx(clustering)
        assert got[v]["local_density"] == pytest.approx(density)


@pytest.mark.parametrize("task_edges", [2_000_000, 0])
def test_betweenness(e, order, pairs, task_edges):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    nodes = [r["account"] for r in order.collect()]
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:  # count shortest paths by listing them
        paths, depth = {s: [[s]]}, {s}
        while paths:
            nxt = {}
            for v, found in paths.items():
                for w in after.get(v, ()):
                    if w not in depth:
                        nxt.setdefault(w, []).extend(p + [w] for p in found)
            for w, found in nxt.items():
                for p in found:
                    for v in p[1:-1]:
                        total[v] += 1 / len(found)
            depth |= set(nxt)
            paths = nxt
    n = len(nodes)
    got = {r["account"]: r["betweenness_centrality"] for r in centrality.betweenness(e, order, task_edges=task_edges).collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in total.items()})


def test_pivots(e, order):
    n = order.count()
    assert centrality.pivot_positions(n) is None
    assert centrality.pivot_positions(2000) == random.Random(42).sample(range(2000), 200)
    all_of_them = centrality.betweenness(e, order, exact_up_to=5, pivots=n).collect()
    assert {r["account"]: r[1] for r in all_of_them} == pytest.approx({r["account"]: r[1] for r in centrality.betweenness(e, order).collect()})


def test_eigenvector(e, pairs):
    near = neighbours(pairs)
    nodes = sorted(near)
    a = np.array([[float(w in near[v]) for w in nodes] for v in nodes]) + np.eye(len(nodes))
    x = np.full(len(nodes), 1 / len(nodes))
    fixed = np.ones(len(nodes))
    for k in range(200):
        if k < 5:
            fixed = a @ fixed
        y = a @ x
        y /= np.linalg.norm(y)
        done = np.abs(y - x).sum() < len(nodes) * 1e-4
        x = y
        if done:
            break
    for task_edges in (2_000_000, 0):
        got = {r["account"]: r[1] for r in centrality.eigenvector(e, task_edges=task_edges).collect()}
        assert got == pytest.approx(dict(zip(nodes, x)))
    assert {r["account"]: r["x"] for r in centrality.eigenvector_rounds(e, 5).collect()} == pytest.approx(dict(zip(nodes, fixed / np.linalg.norm(fixed))))
    assert {r[1] for r in centrality.eigenvector(e, rounds=1).collect()} == {0.0}


def test_communities(e, order):
    small = {r["account"]: r["community_size"] for r in communities.community_sizes(e, order).collect()}
    large = {r["account"]: r["community_size"] for r in communities.community_sizes(e, order, task_edges=0).collect()}
    assert small == large


def test_communities_by_hand():
    # Two triangles joined by one edge stay two communities; a pair is one.
    label = communities.propagate([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (6, 7)])
    groups = {}
    for v, x in label.items():
        groups.setdefault(x, set()).add(v)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [6, 7]]


def test_edges_and_order(spark):
    tx = spark.createDataFrame([(0, "B", "C", 1.0), (1, "A", "B", 2.0), (2, "B", "C", 3.0), (3, "B", "B", 4.0)], "tx_id long, from_account string, to_account string, amount_received double").withColumn("timestamp", F.timestamp_seconds("tx_id").cast("timestamp_ntz"))
    assert {tuple(r) for r in graph.edges(tx).collect()} == {("B", "C", 4.0, 2), ("A", "B", 2.0, 1), ("B", "B", 4.0, 1)}
    assert {r["account"]: r["node_idx"] for r in graph.node_order(tx).collect()} == {"B": 0, "A": 1, "C": 2}
    long = graph.edges_with_history(tx).where("dst = 'C'").first()
    assert (long["amounts"], long["payment_formats"], long["amount"]) == ([1.0, 3.0], ["nan", "nan"], 4.0)
    assert {r["account"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(graph.edges(tx)).collect()} == {"A": (0, 1), "B": (2, 2), "C": (1, 0)}
