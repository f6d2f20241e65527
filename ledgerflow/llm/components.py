"""Connected components of an undirected link table by alternating large and small stars.

Each round is two map-side-combined minimum aggregations and two joins; rounds
grow with the logarithm of the component size. Every round is a written table,
so a lost executor never recomputes earlier rounds. A node of very many links is
a hot key that the joins may split. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .shared import written


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links: two long columns (a, b), any order, loops and repeats allowed.

    Returns (node, component) for every node that has a link to another one;
    component is the least node reachable. Null ends are ignored; an empty
    table gives an empty result.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(),
        "links",
    )
    before = None
    for _ in range(most_rounds):
        edges = written(stars(stars(edges, True), False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(pmod(xxhash64(a, b), 1000000007) as decimal(38,0)))")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
