"""Weakly and strongly connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

TASK_EDGES = 2_000_000


def anew(df: DataFrame, column: str, name: str) -> DataFrame:
    """An aggregate keyed by an equal value under another name. A join on it deals both sides out by itself, so that AQE may split a hot key; on the aggregate's own key the join would reuse its exchange, which cannot be split."""
    same = F.concat(F.col(column), F.lit("")) if dict(df.dtypes)[column] == "string" else F.col(column).bitwiseXOR(F.lit(0))
    return df.select(same.alias(name), *[c for c in df.columns if c != column])


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links a > b: larger neighbours (or the rest) move to the least of each neighbourhood."""
    rows = links.select(F.col("a").alias("n"), F.col("b").alias("v"))
    if large:
        rows = rows.unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("v")))
    least = rows.groupBy("n").agg(F.least(F.col("n"), F.min("v")).alias("m"))
    moved = rows.join(anew(least, "n", "_n"), F.col("n") == F.col("_n")).drop("_n")
    if large:
        out = moved.where("v > n").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component: every node takes the least around it, and that node's own, until nothing moves."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, low):
            return low
        low = new


def join_up(p: pd.DataFrame) -> pd.DataFrame:
    """account, component of links a, b."""
    names, codes = np.unique(np.concatenate([p["a"].to_numpy(object), p["b"].to_numpy(object)]).astype(str), return_inverse=True)
    low = least_linked(codes[: len(p)], codes[len(p) :], len(names))
    return pd.DataFrame({"account": names.astype(object), "component": names[low].astype(object)})


def weak_components(e: DataFrame, rounds: int = 50, task_edges: int = TASK_EDGES) -> DataFrame:
    """account, component (its least account) for every node of edges src, dst: up to task_edges pairs in one task, beyond that by alternating stars, whose rounds grow with the logarithm of a component's size."""
    nodes = e.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    links = written(e.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    if links.count() <= task_edges:
        found = links.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda p: join_up(p), "account string, component string")
        return nodes.join(found, "account", "left").withColumn("component", F.coalesce("component", "account"))
    before = None
    for _ in range(rounds):
        links = written(stars(stars(links, True), False), "stars")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003)))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("weak components did not settle")
    return nodes.join(links.select(F.col("a").alias("account"), F.col("b").alias("component")), "account", "left").withColumn("component", F.coalesce("component", "account"))


def by_parts(e: DataFrame, function, schema: str, task_edges: int = TASK_EDGES, extra: list[str] | None = None, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Run function(edges as pandas) over groups of whole weak components, each of at most about task_edges edges.

    parts: the weak components, where they are known already. Returns the result and the edges of components over that size (null where
    there are none), which need a distributed algorithm.
    """
    extra = extra or []
    parts = weak_components(e, task_edges=task_edges) if parts is None else parts
    rows = written(e.select("src", "dst", *extra).join(parts.withColumnRenamed("account", "src"), "src"), "component-edges")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    total, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    groups = max(int((total or 0) // max(1, task_edges // 8)) + 1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = None
    if (most or 0) > task_edges:
        over = sizes.where(F.col("_size") > task_edges).select("component")
        large = rows.join(over, "component", "left_semi").select("src", "dst", *extra)
        rows = rows.join(over, "component", "left_anti")
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("component"), F.lit(groups))).select("_group", "src", "dst", *extra)
    return grouped.groupBy("_group").applyInPandas(lambda p: function(p.drop(columns="_group")), schema), large


def strong_sizes(src, dst) -> dict:
    """Size of each node's strongly connected component; iterative depth-first search."""
    after: dict = {}
    for a, b in zip(src, dst):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, stack, on, size, clock = {}, {}, [], set(), {}, 0
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = clock
                    clock += 1
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == node:
                            break
                    for m in members:
                        size[m] = len(members)
    return size


def _reach(labels: DataFrame, e: DataFrame, rounds: int) -> DataFrame:
    """Each node's least label over all nodes that reach it within its colour."""
    now = written(labels, "labels")
    for _ in range(rounds):
        new = e.join(now.withColumnRenamed("account", "src"), "src").groupBy(F.col("dst").alias("account")).agg(F.min("label").alias("_l"))
        nxt = written(now.join(new, "account", "left").select("account", F.least("label", F.coalesce("_l", "label")).alias("label"), (F.col("_l") < F.col("label")).alias("_moved")), "labels")
        moved = nxt.where("_moved").isEmpty()
        now = nxt.drop("_moved")
        if moved:
            return now
    raise RuntimeError("labels did not settle")


def strong_components_distributed(e: DataFrame, rounds: int = 100_000) -> DataFrame:
    """account, component_size by rounds of forward colouring and backward matching; for components too large for one task."""
    left = written(e.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    nodes = written(e.select(F.explode(F.array("src", "dst")).alias("account")).distinct(), "scc-nodes")
    done = None
    for _ in range(rounds):
        if nodes.isEmpty():
            break
        colour = _reach(nodes.select("account", F.col("account").alias("label")), left, rounds)
        same = left.join(colour.select(F.col("account").alias("src"), F.col("label").alias("ls")), "src").join(colour.select(F.col("account").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld")
        # A colour's root is its least node; those that reach it within the colour are its strong component.
        back = written(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ls"), "scc-back")
        hit = written(colour.where("account = label"), "scc-hit")
        while True:
            more = back.join(hit.select(F.col("account").alias("src")), "src", "left_semi").select(F.col("dst").alias("account"), F.col("ls").alias("label")).distinct().join(hit, "account", "left_anti")
            more = written(more, "scc-more")
            if more.isEmpty():
                break
            hit = written(hit.unionByName(more), "scc-hit")
        found = hit.join(hit.groupBy("label").agg(F.count(F.lit(1)).alias("component_size")), "label").select("account", "component_size")
        done = found if done is None else done.unionByName(found)
        nodes = written(nodes.join(hit, "account", "left_anti"), "scc-nodes")
        left = written(same.select("src", "dst").join(hit.select(F.col("account").alias("src")), "src", "left_anti").join(hit.select(F.col("account").alias("dst")), "dst", "left_anti"), "scc-edges")
    return done if done is not None else nodes.withColumn("component_size", F.lit(1).cast("long"))


def short_cycle_scores(e: DataFrame, task_edges: int = TASK_EDGES, parts: DataFrame | None = None) -> DataFrame:
    """account, short_cycle_score: the size of the strongly connected component less one."""

    def sizes(p: pd.DataFrame) -> pd.DataFrame:
        found = strong_sizes(p["src"], p["dst"])
        return pd.DataFrame({"account": list(found), "component_size": list(found.values())})

    small, large = by_parts(e, sizes, "account string, component_size long", task_edges, parts=parts)
    out = small if large is None else small.unionByName(strong_components_distributed(large))
    return out.select("account", (F.col("component_size") - 1).cast("double").alias("short_cycle_score"))
