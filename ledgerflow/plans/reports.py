"""Portfolio and alert reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import TIER_ORDER, tier_rank
from ..operators.tables import numbered


def tier_counts(scored: DataFrame) -> DataFrame:
    """tier, accounts for High, Medium and Low, 0 where a tier is empty."""
    domain = scored.sparkSession.createDataFrame([(t,) for t in sorted(TIER_ORDER, key=TIER_ORDER.get, reverse=True)], "tier string")
    counts = scored.groupBy(F.col("risk_tier").alias("tier")).agg(F.count(F.lit(1)).alias("accounts"))
    return domain.join(counts, "tier", "left").select("tier", F.coalesce("accounts", F.lit(0)).alias("accounts"))


def portfolio_summary(tx: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: transactions, accounts, flagged_high, flagged_medium."""
    flags = scored.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count(F.when(F.col("risk_tier") == "High", F.lit(1))).alias("flagged_high"),
        F.count(F.when(F.col("risk_tier") == "Medium", F.lit(1))).alias("flagged_medium"),
    )
    return tx.agg(F.count(F.lit(1)).alias("transactions")).crossJoin(F.broadcast(flags))  # one row each


def alert_feed(scored: DataFrame, least_tier: str = "All", rows: int = 200) -> DataFrame:
    """The riskiest accounts of at least a tier, highest first."""
    if least_tier != "All":
        scored = scored.where(tier_rank(F.col("risk_tier")) >= TIER_ORDER[least_tier])
    return scored.orderBy(F.desc("risk_score"), "account").limit(rows).select("account", "risk_score", "risk_tier", "supervised_probability", "anomaly_score")


def risk_curve(scored: DataFrame) -> DataFrame:
    """position (from 0), risk_score in ascending order."""
    return numbered(scored.select("risk_score", "account"), ["risk_score", "account"], "position").select("position", "risk_score")


def metric_table(metrics: DataFrame) -> DataFrame:
    """metric, value rows of a metrics row."""
    names = [("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1"), ("ROC AUC", "roc_auc"), ("PR AUC", "pr_auc")]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in names])).alias("x")).select("x.*")


def confusion_table(metrics: DataFrame) -> DataFrame:
    """actual, predicted_non_laundering, predicted_laundering."""
    rows = metrics.select(F.posexplode("confusion_matrix").alias("k", "r"))
    return rows.select(F.when(F.col("k") == 0, "Actual Non-Laundering").otherwise("Actual Laundering").alias("actual"), F.col("r")[0].alias("predicted_non_laundering"), F.col("r")[1].alias("predicted_laundering"))
