"""Registered queries over the transactions view of the driver tables. Doubles are rounded to 6 places, from 1000 on to 3: a double has some 15 digits, and sums of them fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import centrality, communities, components, evaluate, explain, flows, graph, learning
from ..operators.quantiles import quantiles
from ..operators.tables import written
from ..sources import sample_view, transactions as source
from . import reports, workflow
from .contract import Config
from .features import account_features

POWER_ROUNDS = 4
MODEL = Config()


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, negative zero gone. The nudge keeps exact halves from going either way."""
    rounded = lambda x: F.when(x == 0, F.lit(0.0)).when(F.abs(x) >= 1000, F.round(x + 1e-7, 3)).otherwise(F.round(x + 1e-9, 6))
    return df.select([rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_view.transactions(spark, sf_dir)


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's columns for features, written once, as several aggregations read them."""
    return written(_tx(spark, sf_dir).select("tx_id", "timestamp", "from_account", "to_account", "amount_received", "is_laundering"), "transactions")


def _proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored accounts from a deterministic proxy, so that report queries have SQL twins without a model."""
    f = flows.both_flows(_tx(spark, sf_dir)).select("account", "outgoing_amount_total", "incoming_amount_total")
    total = F.col("outgoing_amount_total") + F.col("incoming_amount_total")
    raw = f.select("account", (F.col("outgoing_amount_total") / (total + 1.0)).alias("supervised_probability"), total.alias("anomaly_raw"))
    out = risk.min_max(raw, "anomaly_raw", "anomaly_score")
    out = written(tidy(out.withColumn("risk_score", risk.blend(F.col("supervised_probability"), F.col("anomaly_score")))), "proxy")
    cut = quantiles(out.select(F.lit("risk").alias("key"), F.col("risk_score").alias("value")), [0.95, 0.99]).select(F.col("quantiles")[0].alias("_m"), F.col("quantiles")[1].alias("_h"))
    out = out.crossJoin(F.broadcast(cut))  # one row
    return out.select("account", "supervised_probability", "anomaly_score", "risk_score", risk.tier(F.col("risk_score"), F.col("_m"), F.col("_h")).alias("risk_tier"), "anomaly_raw", F.col("_m").alias("medium"), F.col("_h").alias("high"))


def _matched(spark, sf_dir):
    return written(evaluate.matched(_proxy(spark, sf_dir), flows.account_labels(_tx(spark, sf_dir))), "matched")


# ---- sources and cleaning


def scan_transactions(spark, sf_dir):
    return tidy(_tx(spark, sf_dir).drop("receiving_currency", "payment_currency"))


def _dirty(spark, sf_dir):
    """The view as a raw file would have it: strings, with planted bad values."""
    tx = _tx(spark, sf_dir)
    k = F.col("tx_id")
    return tx.select(
        k,
        F.when(k % 28 == 0, "soon").when(k % 3 == 0, F.date_format("timestamp", "M/d/yyyy H:mm")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(k % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit(" \t"), F.col("from_account"), F.lit("\t "))).alias("from_account"),
        "to_account",
        F.when(k % 44 == 0, "x").when(k % 52 == 0, F.lit(None)).otherwise(F.col("amount_received").cast("string")).alias("amount_received"),
        F.when(k % 12 == 0, F.lit(None)).otherwise(F.col("amount_paid").cast("string")).alias("amount_paid"),
        F.when(k % 36 == 0, "x").when(k % 32 == 0, "0.7").when(k % 16 == 0, F.lit(None)).otherwise(F.col("is_laundering").cast("string")).alias("is_laundering"),
    )


def clean_timestamps(spark, sf_dir):
    return source.clean(_dirty(spark, sf_dir)).select("tx_id", "timestamp")


def clean_amounts(spark, sf_dir):
    return tidy(source.clean(_dirty(spark, sf_dir)).select("tx_id", "amount_received", "amount_paid"))


def clean_strings(spark, sf_dir):
    return source.clean(_dirty(spark, sf_dir)).select("tx_id", "from_account")


def clean_labels(spark, sf_dir):
    return source.clean(_dirty(spark, sf_dir)).select("tx_id", "is_laundering")


def laundering_tx(spark, sf_dir):
    return tidy(flows.laundering_only(_tx(spark, sf_dir)).select("tx_id", "from_account", "to_account", "amount_received"))


def time_split(spark, sf_dir):
    parts = source.time_split(_tx(spark, sf_dir))
    named = [p.select("tx_id", F.lit(n).alias("part")) for p, n in zip(parts, ("train", "val", "test"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def downsample(spark, sf_dir):
    return learning.downsample(_tx(spark, sf_dir), ratio=5).select("tx_id", "is_laundering")


# ---- flows


def outgoing_stats(spark, sf_dir):
    return tidy(flows.flow_stats(_tx(spark, sf_dir), "outgoing").select("account", "outgoing_amount_total", "outgoing_amount_mean", "outgoing_amount_std", "outgoing_tx_count", "outgoing_amount_max"))


def incoming_stats(spark, sf_dir):
    return tidy(flows.flow_stats(_tx(spark, sf_dir), "incoming").select("account", "incoming_amount_total", "incoming_amount_mean", "incoming_amount_std", "incoming_tx_count", "incoming_amount_max"))


def counterparties(spark, sf_dir):
    return flows.flow_features(_tx(spark, sf_dir)).select("account", "unique_out_counterparties", "unique_in_counterparties", "total_unique_counterparties")


def concentration(spark, sf_dir):
    return tidy(flows.both_flows(_tx(spark, sf_dir)).select("account", "outgoing_concentration", "incoming_concentration"))


def amount_entropy(spark, sf_dir):
    return tidy(flows.both_flows(_tx(spark, sf_dir)).select("account", "outgoing_entropy", "incoming_entropy"))


def gap_stats(spark, sf_dir):
    return tidy(flows.timing_stats(_tx(spark, sf_dir)).select("account", "max_gap_days", "mean_gap_days"))


def relay_score(spark, sf_dir):
    return tidy(flows.timing_stats(_tx(spark, sf_dir)).select("account", "relay_score"))


def velocity(spark, sf_dir):
    return tidy(flows.flow_features(_tx(spark, sf_dir)).select("account", "tx_count", "velocity_7d"))


def ratios(spark, sf_dir):
    columns = ["in_out_degree_ratio", "in_out_amount_ratio", "cashflow_ratio", "fanout_ratio", "degree_balance", "amount_balance"]
    return tidy(flows.flow_features(_tx(spark, sf_dir)).select("account", *columns))


def all_accounts(spark, sf_dir):
    return flows.all_accounts(_tx(spark, sf_dir))


def account_labels(spark, sf_dir):
    return flows.account_labels(_tx(spark, sf_dir))


def class_balance(spark, sf_dir):
    return tidy(learning.class_balance(flows.account_labels(_tx(spark, sf_dir))))


def daily_volume(spark, sf_dir):
    return tidy(flows.daily_volume(_tx(spark, sf_dir)).withColumn("date", F.col("date").cast("string")))


def account_features_tabular(spark, sf_dir):
    return tidy(flows.tabular_features(_narrow(spark, sf_dir)))


def labeled_features(spark, sf_dir):
    tx = _narrow(spark, sf_dir)
    return tidy(flows.tabular_features(tx).join(flows.account_labels(tx), "account"))


# ---- graph


def _edges(spark, sf_dir):
    return graph.edges(_tx(spark, sf_dir))


def edge_aggregate(spark, sf_dir):
    return tidy(_edges(spark, sf_dir))


def edge_history(spark, sf_dir):
    out = graph.edges_with_history(_tx(spark, sf_dir))
    return out.select("src", "dst", "count", F.array_join(F.transform("amounts", lambda x: F.format_string("%.2f", x)), "|").alias("amounts"), F.array_join("payment_formats", "|").alias("payment_formats"))


def node_order(spark, sf_dir):
    return graph.node_order(_tx(spark, sf_dir))


def undirected_edges(spark, sf_dir):
    return graph.undirected(_edges(spark, sf_dir))


def degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


def clustering(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return tidy(graph.neighbourhoods(graph.edges(tx), flows.all_accounts(tx)).select("account", "clustering_coefficient"))


def local_density(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return tidy(graph.neighbourhoods(graph.edges(tx), flows.all_accounts(tx)).select("account", "local_density"))


def short_cycle_score(spark, sf_dir):
    return components.short_cycle_scores(_edges(spark, sf_dir))


def eigenvector_k(spark, sf_dir):
    return tidy(centrality.eigenvector_rounds(_edges(spark, sf_dir), POWER_ROUNDS))


def eigenvector(spark, sf_dir):
    return tidy(centrality.eigenvector(_edges(spark, sf_dir)))


def betweenness(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return tidy(centrality.betweenness(graph.edges(tx), written(graph.node_order(tx), "order")))


def betweenness_exact(spark, sf_dir):
    """All accounts are sources, whatever their number."""
    tx = _tx(spark, sf_dir)
    order = written(graph.node_order(tx), "order")
    return tidy(centrality.betweenness(graph.edges(tx), order, exact_up_to=order.count()))


def community_size(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return communities.community_sizes(graph.edges(tx), written(graph.node_order(tx), "order"))


def features_36(spark, sf_dir):
    return tidy(account_features(_tx(spark, sf_dir)))


# ---- risk arithmetic and reports on the proxy


def minmax_scale(spark, sf_dir):
    return _proxy(spark, sf_dir).select("account", "anomaly_score")


def risk_blend(spark, sf_dir):
    return _proxy(spark, sf_dir).select("account", "risk_score")


def risk_thresholds(spark, sf_dir):
    return tidy(_proxy(spark, sf_dir).select("medium", "high").distinct())


def risk_tier(spark, sf_dir):
    return _proxy(spark, sf_dir).select("account", "risk_tier")


def tier_counts(spark, sf_dir):
    return reports.tier_counts(_proxy(spark, sf_dir))


def portfolio_summary(spark, sf_dir):
    return reports.portfolio_summary(_tx(spark, sf_dir), _proxy(spark, sf_dir))


def alert_feed(spark, sf_dir):
    return reports.alert_feed(_proxy(spark, sf_dir), "Medium", 50)


def risk_curve(spark, sf_dir):
    return reports.risk_curve(_proxy(spark, sf_dir))


def safe_quantile(spark, sf_dir):
    return tidy(risk.safe_quantile(_tx(spark, sf_dir), "amount_received", 0.9))


# ---- evaluation and explanation on the proxy


def classification_metrics(spark, sf_dir):
    return tidy(_metrics(spark, sf_dir).select("precision", "recall", "f1", "roc_auc", "pr_auc"))


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_matched(spark, sf_dir))


def roc_auc(spark, sf_dir):
    return tidy(evaluate.roc_auc(_matched(spark, sf_dir)))


def average_precision(spark, sf_dir):
    return tidy(evaluate.average_precision(_matched(spark, sf_dir)))


def _metrics(spark, sf_dir):
    return evaluate.evaluate(_proxy(spark, sf_dir), flows.account_labels(_tx(spark, sf_dir)))


def metric_table(spark, sf_dir):
    return tidy(reports.metric_table(_metrics(spark, sf_dir)))


def confusion_table(spark, sf_dir):
    return reports.confusion_table(_metrics(spark, sf_dir))


EXPLAINED = ["outgoing_amount_total", "incoming_amount_total", "outgoing_amount_mean", "incoming_amount_mean", "in_degree", "out_degree", "tx_count", "amount_balance"]


def _explained(spark, sf_dir):
    return written(tidy(flows.flow_features(_tx(spark, sf_dir)).select("account", *EXPLAINED)), "explained")


def feature_mad(spark, sf_dir):
    return tidy(explain.deviations(_explained(spark, sf_dir)))


def explain_mad(spark, sf_dir):
    out = explain.explain_deviation(_explained(spark, sf_dir), top_k=3)
    return out.select("account", "rank", "feature", "direction", F.round("deviation", 4).alias("deviation"))


def reason_text(spark, sf_dir):
    return explain.explain_deviation(_explained(spark, sf_dir), top_k=1).select("account", "reason")


# ---- models


def _run(spark, sf_dir):
    return workflow.run_on(_tx(spark, sf_dir), MODEL)


def scored_accounts(spark, sf_dir):
    return tidy(_run(spark, sf_dir).scored)


def model_metrics(spark, sf_dir):
    return tidy(_run(spark, sf_dir).metrics.drop("confusion_matrix"))


def explain_shap(spark, sf_dir):
    r = _run(spark, sf_dir)
    return tidy(explain.explain_shap(r.features, r.artifacts))


QUERIES = {
    f.__name__: f
    for f in (
        account_features_tabular, scan_transactions, clean_timestamps, clean_amounts, clean_strings, clean_labels, laundering_tx, time_split, downsample,
        outgoing_stats, incoming_stats, counterparties, concentration, amount_entropy, gap_stats, relay_score, velocity, ratios, all_accounts, account_labels, class_balance, daily_volume, labeled_features,
        edge_aggregate, edge_history, node_order, undirected_edges, degrees, clustering, local_density, short_cycle_score, eigenvector_k, eigenvector, betweenness, betweenness_exact, community_size,
        minmax_scale, risk_blend, risk_thresholds, risk_tier, tier_counts, portfolio_summary, alert_feed, risk_curve, safe_quantile,
        classification_metrics, confusion_matrix, roc_auc, average_precision, metric_table, confusion_table, feature_mad, explain_mad, reason_text, scored_accounts, model_metrics, explain_shap,
    )
} | {"account_features": features_36}
