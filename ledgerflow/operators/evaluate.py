"""Metrics of scores against labels. One class or no labelled row gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def matched(scored: DataFrame, labels: DataFrame, score: str = "risk_score") -> DataFrame:
    return scored.join(labels, "account").select(F.col(score).cast("double").alias("p"), F.col("label").cast("int").alias("y"))


def confusion(m: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp at p >= threshold."""
    hit = (F.col("p") >= threshold).cast("int")
    n = lambda y, h: F.count(F.when((F.col("y") == y) & (hit == h), F.lit(1)))
    return m.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def by_score(m: DataFrame) -> DataFrame:
    """One row a distinct score with its positives and negatives, and those at higher scores.

    Distinct scores stay many, so the running sums go in two steps: within
    buckets of the score, and over the buckets.
    """
    groups = m.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("b", F.floor(F.col("p") * 1024).cast("long"))
    totals = groups.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most about a thousand rows for scores in 0..1
    offsets = totals.select("b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("op"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("on"))
    inside = Window.partitionBy("b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        groups.withColumns({"ip": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "in": F.coalesce(F.sum("neg").over(inside), F.lit(0))})
        .join(F.broadcast(offsets), "b")
        .select("p", "pos", "neg", (F.col("ip") + F.col("op")).alias("pos_above"), (F.col("in") + F.col("on")).alias("neg_above"))
    )


def _roc_auc() -> Column:
    return F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)), F.sum("pos") * F.sum("neg")).alias("roc_auc")


def _average_precision() -> Column:
    seen = F.col("pos_above") + F.col("pos")
    return F.try_divide(F.sum(F.col("pos") * seen / (seen + F.col("neg_above") + F.col("neg"))), F.sum("pos")).alias("average_precision")


def roc_auc(m: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count half."""
    return by_score(m).agg(_roc_auc())


def average_precision(m: DataFrame) -> DataFrame:
    """Sum over distinct scores, highest first, of the recall gained times the precision so far."""
    return by_score(m).agg(_average_precision())


def evaluate(scored: DataFrame, labels: DataFrame, threshold: float = 0.5, score: str = "risk_score") -> DataFrame:
    """One row: precision, recall, f1, roc_auc, pr_auc, confusion_matrix [[tn, fp], [fn, tp]]."""
    m = written(matched(scored, labels, score), "matched")
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    curve = by_score(m).agg(_roc_auc(), _average_precision())  # the running sums are made once
    one = confusion(m, threshold).crossJoin(F.broadcast(curve))  # one row each
    return one.where("tn + fp > 0 and fn + tp > 0").select(
        zero(c("tp"), c("tp") + c("fp")).alias("precision"),
        zero(c("tp"), c("tp") + c("fn")).alias("recall"),
        zero(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        "roc_auc",
        F.col("average_precision").alias("pr_auc"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )
