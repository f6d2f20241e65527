"""Column contracts and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Feature columns in contract order.
FEATURE_COLUMNS = [
    "in_degree",
    "out_degree",
    "betweenness_centrality",
    "eigenvector_centrality",
    "clustering_coefficient",
    "relay_score",
    "local_density",
    "short_cycle_score",
    "community_size",
    "is_isolated",
    "outgoing_amount_total",
    "outgoing_amount_mean",
    "outgoing_amount_std",
    "unique_out_counterparties",
    "outgoing_concentration",
    "outgoing_entropy",
    "incoming_amount_total",
    "incoming_amount_mean",
    "incoming_amount_std",
    "unique_in_counterparties",
    "incoming_concentration",
    "incoming_entropy",
    "max_gap_days",
    "mean_gap_days",
    "tx_count",
    "velocity_7d",
    "weighted_in_degree",
    "weighted_out_degree",
    "weighted_degree",
    "total_unique_counterparties",
    "in_out_degree_ratio",
    "in_out_amount_ratio",
    "cashflow_ratio",
    "fanout_ratio",
    "degree_balance",
    "amount_balance",
]
COUNTS = {"in_degree", "out_degree", "community_size", "is_isolated", "tx_count", "total_unique_counterparties", "degree_balance", "unique_out_counterparties", "unique_in_counterparties"}

TRANSACTIONS = T.StructType(
    [T.StructField("tx_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ("from_bank", "from_account", "to_bank", "to_account")]
    + [T.StructField(c, T.DoubleType()) for c in ("amount_received", "amount_paid")]
    + [T.StructField(c, T.StringType()) for c in ("receiving_currency", "payment_currency", "payment_format")]
    + [T.StructField("is_laundering", T.IntegerType())]
)
FEATURES = T.StructType([T.StructField("account", T.StringType())] + [T.StructField(c, T.LongType() if c in COUNTS else T.DoubleType()) for c in FEATURE_COLUMNS])
LABELS = T.StructType([T.StructField("account", T.StringType()), T.StructField("label", T.IntegerType())])


@dataclass(frozen=True)
class Config:
    """Settings that drive the plans; defaults give the documented behaviour."""

    top_alerts: int = 200
    temporal_window_days: int = 7
    random_state: int = 42
    exact_betweenness_nodes: int = 1000
    betweenness_pivots: int = 200
    density_cutoff: int = 100
    eigenvector_rounds: int = 200
    eigenvector_tolerance: float = 1e-4
    quantile_medium: float = 0.95
    quantile_high: float = 0.99
    supervised_weight: float = 0.80
    decision_threshold: float = 0.5
    least_training_rows: int = 10
    boosting_rounds: int = 300
    boosting_depth: int = 6
    boosting_step: float = 0.05
    isolation_trees: int = 300
    isolation_rows: int = 256
    task_edges: int = 2_000_000  # a graph part up to this many edges may be one task's work
    task_rows: int = 20_000  # training rows a task
