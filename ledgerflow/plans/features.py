"""The account feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import centrality, communities, components, flows, graph
from ..operators.tables import written
from .contract import FEATURES, Config


def account_features(tx: DataFrame, config: Config = Config()) -> DataFrame:
    """account and the 36 features in contract order; no transactions give a typed empty frame."""
    tx = written(tx.select("tx_id", "timestamp", "from_account", "to_account", "amount_received"), "transactions")
    if tx.isEmpty():
        return tx.sparkSession.createDataFrame([], FEATURES)
    e = written(graph.edges(tx), "edges")
    order = written(graph.node_order(tx), "node-order")
    parts = written(components.weak_components(e), "weak-components")
    out = (
        flows.tabular_features(tx, config.temporal_window_days)
        .join(graph.neighbourhoods(e, order, config.density_cutoff), "account")
        .join(centrality.eigenvector(e, config.eigenvector_rounds, config.eigenvector_tolerance, config.task_edges), "account")
        .join(centrality.betweenness(e, order, config.exact_betweenness_nodes, config.betweenness_pivots, config.random_state, config.task_edges, parts), "account")
        .join(components.short_cycle_scores(e, config.task_edges, parts), "account")
        .join(communities.community_sizes(e, order, config.task_edges, parts), "account")
    )
    return out.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.lit(0).cast(f.dataType)).alias(f.name) if f.name != "account" else F.col("account") for f in FEATURES])
