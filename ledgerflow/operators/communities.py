"""Communities by semi-synchronous label propagation.

Cordasco and Gargano (2010): nodes are coloured greedily, largest degree first;
colour by colour, every node takes the most frequent label around it, its own
if that is among the best, else the greatest of them; until each node's label
is among its best. Labels start as node positions, so the result is determined.
A component evolves by itself, so groups of components are separate tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import TASK_EDGES, by_parts
from .tables import written


def propagate(pairs) -> dict[int, int]:
    """Label of each node of an undirected graph of (node, node) positions."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    weight = {v: len(x) + (v in x) for v, x in near.items()}  # a self-loop counts twice in a degree
    colour: dict[int, int] = {}
    for v in sorted(near, key=lambda v: (-weight[v], v)):
        used = {colour[w] for w in near[v] if w in colour}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    classes: dict[int, list[int]] = {}
    for v, c in colour.items():
        classes.setdefault(c, []).append(v)
    label = {v: v for v in near}

    def best(v: int) -> tuple[bool, int]:
        """Whether v's own label is among the most frequent around it, and the greatest of those; each is counted once."""
        counts: dict[int, int] = {}
        for w in near[v]:
            x = label[w]
            counts[x] = counts.get(x, 0) + 1
        top = max(counts.values())
        return counts.get(label[v]) == top, max(x for x, n in counts.items() if n == top)

    # A node looks again only when a label around it has moved, so that a settled component costs nothing in the rounds of others.
    restless = set(near)
    while restless:
        settled = True
        for c in sorted(classes):
            for v in classes[c]:
                if v in restless:
                    restless.discard(v)
                    own, top = best(v)
                    if not own:
                        settled = False
                        label[v] = top
                        restless |= near[v]
        if settled:
            break
    return label


def propagate_distributed(e: DataFrame, rounds: int = 1000) -> DataFrame:
    """idx, label for edges si, di of components too large for one task; the same rules as joins."""
    near = written(e.select(F.col("si").alias("v"), F.col("di").alias("w")).union(e.select("di", "si")).distinct(), "near")
    nodes = written(near.groupBy("v").agg((F.count(F.lit(1)) + F.max((F.col("v") == F.col("w")).cast("int"))).alias("weight")), "nodes")
    # A node is coloured once all neighbours before it are: the same colours as one greedy pass.
    rank = lambda p: F.struct((-F.col(f"{p}_weight")).alias("k"), F.col(p).alias("i"))
    both = near.where("v <> w").join(nodes.withColumnRenamed("weight", "v_weight"), "v").join(nodes.select(F.col("v").alias("w"), F.col("weight").alias("w_weight")), "w")
    earlier = written(both.where(rank("w") < rank("v")).select("v", "w"), "earlier")
    coloured = written(nodes.select("v").limit(0).withColumn("colour", F.lit(0)), "colours")
    left = written(nodes.select("v"), "uncoloured")
    while not left.isEmpty():
        waits = earlier.join(left.withColumnRenamed("v", "w"), "w", "left_semi").select("v").distinct()
        ready = left.join(waits, "v", "left_anti")
        used = ready.join(earlier, "v", "left").join(coloured.select(F.col("v").alias("w"), "colour"), "w", "left").groupBy("v").agg(F.collect_set("colour").alias("used"))
        new = written(used.select("v", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("colour")), "ready")
        coloured = written(coloured.unionByName(new), "colours")
        left = written(left.join(new, "v", "left_anti"), "uncoloured")
    most = coloured.agg(F.max("colour")).first()[0]
    label = written(nodes.select("v", F.col("v").alias("label")), "labels")

    def best(of: DataFrame) -> DataFrame:
        counts = of.join(near, "v").join(label.select(F.col("v").alias("w"), F.col("label").alias("l")), "w").groupBy("v", "l").agg(F.count(F.lit(1)).alias("n"))
        top = counts.withColumn("t", F.max("n").over(Window.partitionBy("v"))).where("n = t").join(label, "v")
        return top.groupBy("v", "label").agg(F.max((F.col("l") == F.col("label")).cast("int")).alias("own"), F.max("l").alias("top"))

    for _ in range(rounds):
        if best(nodes.select("v")).where("own = 0").isEmpty():
            return label.select(F.col("v").alias("idx"), "label")
        for c in range(most + 1):
            new = best(coloured.where(F.col("colour") == c).select("v")).select("v", F.when(F.col("own") == 1, F.col("label")).otherwise(F.col("top")).alias("_new"))
            label = written(label.join(new, "v", "left").select("v", F.coalesce("_new", "label").alias("label")), "labels")
    raise RuntimeError("labels did not settle")


def community_sizes(e: DataFrame, order: DataFrame, task_edges: int = TASK_EDGES, parts: DataFrame | None = None) -> DataFrame:
    """account, community_size. order: account, node_idx."""
    idx = lambda c, i: order.select(F.col("account").alias(c), F.col("node_idx").alias(i))
    rows = e.select("src", "dst").join(idx("src", "si"), "src").join(idx("dst", "di"), "dst")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = propagate(zip(p["si"].tolist(), p["di"].tolist()))
        return pd.DataFrame({"idx": list(found), "label": list(found.values())})

    small, large = by_parts(rows, run, "idx long, label long", task_edges, ["si", "di"], parts)
    labels = written(small if large is None else small.unionByName(propagate_distributed(large)), "communities")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"))
    return labels.join(sizes, "label").join(order.withColumnRenamed("node_idx", "idx"), "idx").select("account", "community_size")
