"""The account graph: edges, node order, degrees, triangles, density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered


def edges(tx: DataFrame) -> DataFrame:
    """src, dst, amount, count: one row an ordered pair of accounts; self-loops stay."""
    return tx.groupBy(F.col("from_account").alias("src"), F.col("to_account").alias("dst")).agg(F.sum(F.coalesce("amount_received", F.lit(0.0))).alias("amount"), F.count(F.lit(1)).alias("count"))


def edges_with_history(tx: DataFrame) -> DataFrame:
    """edges plus the transactions' amounts, timestamps, formats and currencies as arrays in time order. Only for reports on few edges: arrays grow with the pair's transactions."""
    text = lambda c: F.coalesce(F.col(c), F.lit("nan")) if c in tx.columns else F.lit("nan")
    row = F.struct("timestamp", "tx_id", F.coalesce("amount_received", F.lit(0.0)).alias("a"), text("payment_format").alias("f"), text("receiving_currency").alias("r"), text("payment_currency").alias("p"))
    out = tx.groupBy(F.col("from_account").alias("src"), F.col("to_account").alias("dst")).agg(F.sort_array(F.collect_list(row)).alias("h"))
    return out.select(
        "src",
        "dst",
        F.aggregate("h.a", F.lit(0.0), lambda s, x: s + x).alias("amount"),
        F.size("h").cast("long").alias("count"),
        F.col("h.a").alias("amounts"),
        F.col("h.timestamp").alias("timestamps"),
        F.col("h.f").alias("payment_formats"),
        F.col("h.r").alias("receiving_currencies"),
        F.col("h.p").alias("payment_currencies"),
    )


def node_order(tx: DataFrame) -> DataFrame:
    """account, node_idx: senders by first transaction, then the receivers that never send, by theirs."""
    both = tx.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), "tx_id", F.col("from_account").alias("account")), F.struct(F.lit(1).alias("side"), "tx_id", F.col("to_account").alias("account")))).alias("x"))
    first = both.groupBy("x.account").agg(F.min(F.struct("x.side", "x.tx_id")).alias("f")).select("account", F.col("f.side").alias("_side"), F.col("f.tx_id").alias("_tx"))
    return numbered(first, ["_side", "_tx", "account"], "node_idx").select("account", "node_idx")


def degrees(e: DataFrame) -> DataFrame:
    """account, in_degree, out_degree; a self-loop counts in both."""
    rows = e.select(F.explode(F.array(F.struct(F.col("src").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("account"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return rows.groupBy("x.account").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def undirected(e: DataFrame) -> DataFrame:
    """a < b: each pair with an edge either way, once; self-loops left out."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def undirected_degrees(u: DataFrame) -> DataFrame:
    return u.select(F.explode(F.array("a", "b")).alias("account")).groupBy("account").agg(F.count(F.lit(1)).alias("degree"))


def triangles(u: DataFrame) -> DataFrame:
    """account, triangles. Pairs point from the smaller to the larger (degree, account), so a node starts at most about sqrt(2m) of them and hubs start few: no wedge list grows with a hub's square."""
    d = undirected_degrees(u)
    marked = u.join(d.select(F.col("account").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("account").alias("b"), F.col("degree").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    out = marked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    one, two = out.alias("one"), out.alias("two")
    wedges = one.join(two, (F.col("one.x") == F.col("two.x")) & (F.col("one.y") < F.col("two.y"))).select(F.col("one.x").alias("x"), F.col("one.y").alias("a"), F.col("two.y").alias("b"))
    found = wedges.join(u, ["a", "b"])
    return found.select(F.explode(F.array("x", "a", "b")).alias("account")).groupBy("account").agg(F.count(F.lit(1)).alias("triangles"))


def neighbourhoods(e: DataFrame, accounts: DataFrame, cutoff: int = 100) -> DataFrame:
    """account, clustering_coefficient, local_density for every account.

    Density of the subgraph on a node and its neighbours in closed form: with d
    neighbours and T triangles it has d + T edges and the self-loops of its
    members, over (d + 1) * d / 2 pairs. With at most one neighbour or over
    cutoff of them (the node itself counts if it has a self-loop), clustering
    stands in.
    """
    u = undirected(e)
    loops = e.where("src = dst").select(F.col("src").alias("account")).distinct().withColumn("loop", F.lit(1))
    around = (
        u.select(F.explode(F.array(F.struct(F.col("a").alias("account"), F.col("b").alias("near")), F.struct(F.col("b").alias("account"), F.col("a").alias("near")))).alias("x"))
        .select("x.account", "x.near")
        .join(loops.select(F.col("account").alias("near"), "loop"), "near")
        .groupBy("account")
        .agg(F.count(F.lit(1)).alias("near_loops"))
    )
    out = accounts.select("account").join(undirected_degrees(u), "account", "left").join(triangles(u), "account", "left").join(loops, "account", "left").join(around, "account", "left").fillna(0)
    d, t = F.col("degree"), F.col("triangles")
    clustering = F.when(d >= 2, 2.0 * t / (d * (d - 1))).otherwise(F.lit(0.0))
    near = d + F.col("loop")
    dense = (d + t + F.col("loop") + F.col("near_loops")) / F.greatest((d + 1) * d / 2.0, F.lit(1.0))
    return out.select("account", clustering.alias("clustering_coefficient"), F.when((near > 1) & (near <= cutoff), dense).otherwise(clustering).alias("local_density"))
