"""Risk arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import ONE_TASK_ROWS
from ..operators.tables import numbered, written

TIER_ORDER = {"Low": 0, "Medium": 1, "High": 2}
SPAN_FLOOR = 1e-9

# Phrases for features in reasons.
PHRASES = {
    "supervised_probability": "high supervised laundering probability",
    "anomaly_score": "unusual behavior relative to peers",
    "betweenness_centrality": "broker-like position in the network",
    "velocity_7d": "high transaction velocity",
    "relay_score": "relay-like timing pattern",
    "short_cycle_score": "short-cycle participation",
    "incoming_concentration": "incoming amount concentration",
    "outgoing_concentration": "outgoing amount concentration",
    "amount_balance": "large imbalance between inflows and outflows",
    "degree_balance": "imbalance between incoming and outgoing counterparties",
    "max_gap_days": "long inactivity gap followed by activity",
    "local_density": "dense neighborhood structure",
}


def min_max(df: DataFrame, column: str, out: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Scale a column to 0..1 over the whole frame, or by given bounds; a span up to SPAN_FLOOR gives zeros. NaN and null are left out of the bounds and stay null."""
    value = F.when(~F.isnan(F.col(column)), F.col(column))
    if low is None:
        bounds = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        df = df.crossJoin(F.broadcast(bounds))  # one row
        lo, hi, drop = F.col("_low"), F.col("_high"), ["_low", "_high"]
    else:
        lo, hi, drop = F.lit(low), F.lit(high), []
    return df.withColumn(out, F.when(hi - lo > SPAN_FLOOR, (value - lo) / (hi - lo)).otherwise(F.lit(0.0))).drop(*drop)


def blend(supervised: Column, anomaly: Column, weight: float = 0.80) -> Column:
    return F.lit(weight) * supervised + F.lit(round(1 - weight, 12)) * anomaly


def tier(risk: Column, medium, high) -> Column:
    """Low up to medium, Medium up to high, High above; null and NaN are Low."""
    return F.when(risk.isNull() | F.isnan(risk) | (risk <= medium), "Low").when(risk <= high, "Medium").otherwise("High")


def tier_rank(column: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TIER_ORDER.items() for x in kv])[column]


def phrase(feature: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, feature), F.replace(feature, F.lit("_"), F.lit(" ")))


def deviation_text(feature: Column, direction: Column) -> Column:
    return F.concat(phrase(feature), F.lit(" ("), direction, F.lit(" than the portfolio median)"))


def contribution_text(feature: Column, value: Column) -> Column:
    return F.concat(feature, F.when(value > 0, F.lit(" increased")).otherwise(F.lit(" decreased")), F.lit(" the model risk score"))


def safe_quantile(df: DataFrame, column: str, q: float, default: float = 0.0, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """One row: the exact quantile by linear interpolation, or default where there is no value. The built-in percentile keeps all distinct values in one task, so beyond one_task_rows rows are range-sorted (NaN last, as there) and picked by position."""
    values = written(df.select(F.col(column).cast("double").alias("value")).where("value is not null"), "values")
    n = values.count()
    if n <= one_task_rows:
        return values.agg(F.coalesce(F.percentile("value", F.lit(q)), F.lit(default)).alias("quantile"))
    rank = q * (n - 1)
    ends = numbered(values, ["value"], "_at").where(F.col("_at").isin(math.floor(rank), math.ceil(rank)))
    low, high = F.min("value"), F.max("value")
    return ends.agg(F.when(low == high, low).otherwise(low + (high - low) * (rank - math.floor(rank))).alias("quantile"))
