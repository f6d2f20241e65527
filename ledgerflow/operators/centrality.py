"""Eigenvector and betweenness centrality."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import TASK_EDGES, by_parts, least_linked
from .tables import written

DENSE_NODES = 256


def adjacency(e: DataFrame) -> DataFrame:
    """src, dst of the undirected graph, each pair both ways once; self-loops once."""
    return e.select("src", "dst").union(e.select("dst", "src")).distinct()


def power_step(x: DataFrame, adj: DataFrame) -> DataFrame:
    """(A + I) x for x(account, x)."""
    moved = adj.join(x.withColumnRenamed("account", "src"), "src").select(F.col("dst").alias("account"), "x")
    return moved.unionByName(x).groupBy("account").agg(F.sum("x").alias("x"))


def _unit(x: DataFrame) -> DataFrame:
    norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    return x.crossJoin(F.broadcast(norm)).select("account", (F.col("x") / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))).alias("x"))


def eigenvector_rounds(e: DataFrame, rounds: int) -> DataFrame:
    """account, x after a fixed number of power steps from equal starts. Scaling commutes with the steps, so it is done once."""
    adj = written(adjacency(e), "adjacency")
    x = adj.select(F.col("src").alias("account")).distinct().withColumn("x", F.lit(1.0))
    for k in range(1, rounds + 1):
        x = power_step(x, adj)
        if k % 4 == 0:
            x = written(_unit(x), "power")
    return _unit(x)


def eigenvector(e: DataFrame, rounds: int = 200, tolerance: float = 1e-4, task_edges: int = TASK_EDGES) -> DataFrame:
    """account, eigenvector_centrality: power steps with A + I from equal starts, until the summed change is below nodes * tolerance; all 0 if that takes over rounds steps."""
    adj = written(adjacency(e), "adjacency")
    if adj.count() <= 2 * task_edges:

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            codes, names = pd.factorize(pd.concat([p["src"], p["dst"]], ignore_index=True))
            a, b = codes[: len(p)], codes[len(p) :]
            n = len(names)
            x = np.full(n, 1.0 / n)
            for _ in range(rounds):
                y = x + np.bincount(b, x[a], n)
                y /= np.sqrt((y * y).sum()) or 1.0
                done = np.abs(y - x).sum() < n * tolerance
                x = y
                if done:
                    return pd.DataFrame({"account": names, "eigenvector_centrality": x})
            return pd.DataFrame({"account": names, "eigenvector_centrality": 0.0})

        return adj.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda p: solve(p), "account string, eigenvector_centrality double")
    nodes = written(adj.select(F.col("src").alias("account")).distinct(), "nodes")
    n = nodes.count()
    x = nodes.withColumn("x", F.lit(1.0 / n))
    for _ in range(rounds):
        y = written(_unit(power_step(x, adj)), "power")
        change = y.join(x.withColumnRenamed("x", "_x"), "account").agg(F.sum(F.abs(F.col("x") - F.col("_x")))).first()[0]
        x = y
        if change < n * tolerance:
            return x.withColumnRenamed("x", "eigenvector_centrality")
    return nodes.withColumn("eigenvector_centrality", F.lit(0.0))


def pivot_positions(n: int, exact_up_to: int = 1000, pivots: int = 200, seed: int = 42) -> list[int] | None:
    """Positions in node order of the sampled sources; None: all nodes are sources."""
    return None if n <= exact_up_to else random.Random(seed).sample(range(n), min(pivots, n))


def _dependencies(p: pd.DataFrame) -> pd.DataFrame:
    """Summed dependencies of all nodes on the flagged sources. Each weak component is worked out by itself, so that a source costs what its component has and not what the task has."""
    codes, names = pd.factorize(pd.concat([p["src"], p["dst"]], ignore_index=True))
    a, b, n = codes[: len(p)], codes[len(p) :], len(names)
    part = least_linked(a, b, n)
    order = np.argsort(part, kind="stable")  # a component's nodes are neighbours
    at = np.empty(n, int)
    at[order] = np.arange(n)
    sources = np.unique(at[a[p["pivot"].to_numpy(bool)]])
    loop = a != b
    a, b = at[a[loop]], at[b[loop]]
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    bounds = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, n]
    edge, source = np.searchsorted(a, bounds), np.searchsorted(sources, bounds)
    total = np.zeros(n)
    for k in np.flatnonzero((np.diff(edge) > 0) & (np.diff(source) > 0)):
        low, high = bounds[k], bounds[k + 1]
        links = slice(edge[k], edge[k + 1])
        found = _dense if high - low <= DENSE_NODES else _sparse
        total[low:high] = found(a[links] - low, b[links] - low, high - low, sources[source[k] : source[k + 1]] - low)
    return pd.DataFrame({"account": names[order], "dependency": total})


def _dense(a: np.ndarray, b: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """All sources of a small component at once, level by level as matrix products."""
    links, row = np.zeros((n, n)), np.arange(len(sources))
    np.add.at(links, (a, b), 1.0)
    front = np.zeros((len(sources), n))
    front[row, sources] = 1.0
    unseen, levels = front == 0, [front]
    while (front := (front @ links) * unseen).any():
        unseen &= front == 0
        levels.append(front)
    delta = np.zeros_like(levels[0])
    for level in range(len(levels) - 1, 0, -1):
        share = np.divide(1 + delta, levels[level], out=np.zeros_like(delta), where=levels[level] > 0)
        delta += levels[level - 1] * (share @ links.T)
    delta[row, sources] = 0.0
    return delta.sum(0)


def _sparse(a: np.ndarray, b: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """Source by source, level by level on whole arrays; links are ordered by a."""
    first = np.searchsorted(a, np.arange(n + 1))
    total = np.zeros(n)
    for s in sources:
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[s], paths[s] = 0, 1.0
        front, level, steps = np.array([s]), 0, []
        while len(front):
            counts = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            u, v = a[at], b[at]
            new = depth[v] < 0
            depth[v[new]] = level + 1
            good = depth[v] == level + 1
            u, v = u[good], v[good]
            np.add.at(paths, v, paths[u])
            steps.append((u, v))
            front, level = np.unique(v), level + 1
        delta = np.zeros(n)
        for u, v in reversed(steps):
            np.add.at(delta, u, paths[u] / paths[v] * (1 + delta[v]))
        delta[s] = 0.0
        total += delta
    return total


def dependencies_distributed(e: DataFrame) -> DataFrame:
    """The same sums as joins, for components too large for one task: e has src, dst and pivot (of src). State is one row a source and reached node."""
    links = written(e.where("src <> dst").select("src", "dst").distinct(), "bfs-links")
    front = written(e.where("pivot").select(F.col("src").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "bfs-0")
    levels, seen = [front], front.select("s", "v")
    while not front.isEmpty():
        nxt = front.join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("w")).agg(F.sum("paths").alias("paths"))
        front = written(nxt.join(seen.withColumnRenamed("v", "w"), ["s", "w"], "left_anti").withColumnRenamed("w", "v").select("s", "v", "paths"), f"bfs-{len(levels)}")
        levels.append(front)
        seen = written(seen.unionByName(front.select("s", "v")), "bfs-seen")
    delta = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("delta"))
    out = None
    for level in reversed(levels[:-1]):
        below = delta.select("s", F.col("v").alias("w"), F.col("paths").alias("_p"), F.col("delta").alias("_d"))
        part = level.join(links, F.col("v") == F.col("src")).join(below, (below["s"] == level["s"]) & (F.col("dst") == F.col("w"))).select(level["s"], "v", (F.col("paths") / F.col("_p") * (1 + F.col("_d"))).alias("_x"))
        delta = written(level.join(part.groupBy("s", "v").agg(F.sum("_x").alias("_x")), ["s", "v"], "left").select("s", "v", "paths", F.coalesce("_x", F.lit(0.0)).alias("delta")), "bfs-delta")
        one = delta.where("s <> v").select(F.col("v").alias("account"), F.col("delta").alias("dependency"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("account").agg(F.sum("dependency").alias("dependency"))


def betweenness(e: DataFrame, order: DataFrame, exact_up_to: int = 1000, pivots: int = 200, seed: int = 42, task_edges: int = TASK_EDGES, parts: DataFrame | None = None) -> DataFrame:
    """account, betweenness_centrality of the directed unweighted graph, normalised. order: account, node_idx; above exact_up_to nodes only sampled sources count, scaled up."""
    n = order.count()
    chosen = pivot_positions(n, exact_up_to, pivots, seed)
    if chosen is None:
        flagged = e.select("src", "dst", F.lit(True).alias("pivot"))
    else:
        wanted = order.where(F.col("node_idx").isin(chosen)).select(F.col("account").alias("src"), F.lit(True).alias("pivot"))
        flagged = e.select("src", "dst").join(F.broadcast(wanted), "src", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    small, large = by_parts(flagged, _dependencies, "account string, dependency double", task_edges, ["pivot"], parts)
    found = small if large is None else small.unionByName(dependencies_distributed(large))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / len(chosen) if chosen else 1.0)
    return order.select("account").join(found, "account", "left").select("account", (F.coalesce("dependency", F.lit(0.0)) * scale).alias("betweenness_centrality"))
