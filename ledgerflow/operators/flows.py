"""Account aggregates over transactions: flows, gaps, relay timing, labels, volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
RELAY_DECAY_DAYS = 3.0


def _side(tx: DataFrame, own: str, other: str) -> DataFrame:
    return tx.select(F.col(own).alias("account"), F.col(other).alias("other"), F.coalesce("amount_received", F.lit(0.0)).alias("v"))


def _micros(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


def entropy_of_sums(total, weighted):
    """Shannon entropy in bits of v / sum(v) over positive v, from sum(v) and sum(v * log2 v): one pass, no second shuffle."""
    bits = F.log2(total) - weighted / total
    return F.when((total > 0) & (bits > 1e-12), bits).otherwise(F.lit(0.0))  # below that it is rounding: one value has no entropy


def flow_stats(tx: DataFrame, side: str) -> DataFrame:
    """Per account of one side ("outgoing" or "incoming"): totals, mean, sample deviation (one row: 0), count, distinct counterparties, concentration and entropy of received amounts."""
    own, other = ("from_account", "to_account") if side == "outgoing" else ("to_account", "from_account")
    unique = "unique_out_counterparties" if side == "outgoing" else "unique_in_counterparties"
    positive = F.when(F.col("v") > 0, F.col("v"))
    out = _side(tx, own, other).groupBy("account").agg(
        F.sum("v").alias(f"{side}_amount_total"),
        F.avg("v").alias(f"{side}_amount_mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias(f"{side}_amount_std"),
        F.count("v").alias(f"{side}_tx_count"),
        F.max("v").alias(f"{side}_amount_max"),
        F.count_distinct("other").alias(unique),
        F.sum(positive).alias("_s"),
        F.sum(positive * F.log2(positive)).alias("_w"),
    )
    total = F.col(f"{side}_amount_total")
    return out.withColumns(
        {
            f"{side}_concentration": F.try_divide(F.col(f"{side}_amount_max"), total + 1e-9),
            f"{side}_entropy": entropy_of_sums(F.coalesce("_s", F.lit(0.0)), F.coalesce("_w", F.lit(0.0))),
        }
    ).drop("_s", "_w")


def timeline(tx: DataFrame) -> DataFrame:
    """Both sides' events: account, t (microseconds), is_out. A self-transfer is two events."""
    t = tx.select("from_account", "to_account", _micros("timestamp").alias("t"))
    return t.select(F.col("from_account").alias("account"), "t", F.lit(True).alias("is_out")).unionByName(t.select(F.col("to_account").alias("account"), "t", F.lit(False).alias("is_out")))


def timing_stats(tx: DataFrame) -> DataFrame:
    """Per account: max_gap_days, mean_gap_days, relay_score.

    Windows run within (account, day), and the days' summaries are joined up by
    a second window, so an account with a third of all events is many tasks'
    work and its second window has one row a day. Relay pairs each incoming
    event with the first outgoing one at or after it: a running minimum from the
    latest event down, as a frame that grows is linear and one that shrinks is not.
    """
    rows = timeline(tx).withColumn("day", F.floor(F.col("t") / F.lit(DAY_US)).cast("long")).withColumn("s", F.col("t") - F.col("day") * F.lit(DAY_US))
    by_day = Window.partitionBy("account", "day").orderBy("s")
    down = Window.partitionBy("account", "day").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # ties count
    rows = rows.select(
        "account",
        "day",
        "s",
        "is_out",
        (F.col("s") - F.lag("s").over(by_day)).alias("gap"),
        F.when(~F.col("is_out"), F.min(F.when(F.col("is_out"), F.col("s"))).over(down)).alias("next_out"),
    )
    waits = ~F.col("is_out") & F.col("next_out").isNull()
    days = rows.groupBy("account", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("s").alias("first"),
        F.max("s").alias("last"),
        F.max("gap").alias("gap"),
        F.min(F.when(F.col("is_out"), F.col("s"))).alias("first_out"),
        F.sum((F.col("next_out") - F.col("s")).cast("double")).alias("paired"),
        F.count("next_out").alias("pairs"),
        F.count(F.when(waits, F.lit(1))).alias("waiting"),
        F.sum(F.when(waits, F.col("s").cast("double"))).alias("waiting_sum"),
    )
    order = Window.partitionBy("account").orderBy("day")
    at = lambda c: F.col("day") * F.lit(DAY_US) + F.col(c)
    days = days.withColumns(
        {
            "before": F.lag(at("last")).over(order),
            "later_out": F.min(at("first_out")).over(Window.partitionBy("account").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    wait_total = F.when((F.col("waiting") > 0) & F.col("later_out").isNotNull(), (F.col("later_out") - F.col("day") * F.lit(DAY_US)).cast("double") * F.col("waiting") - F.col("waiting_sum"))
    per = days.groupBy("account").agg(
        F.max(F.greatest("gap", at("first") - F.col("before"))).alias("_max"),
        (F.max(at("last")) - F.min(at("first"))).alias("_span"),
        F.sum("n").alias("_n"),
        F.sum(F.coalesce("paired", F.lit(0.0)) + F.coalesce(wait_total, F.lit(0.0))).alias("_delta"),
        F.sum(F.col("pairs") + F.when(wait_total.isNotNull(), F.col("waiting")).otherwise(0)).alias("_pairs"),
    )
    return per.select(
        "account",
        (F.coalesce("_max", F.lit(0)) / F.lit(float(DAY_US))).alias("max_gap_days"),
        F.when(F.col("_n") > 1, F.col("_span") / (F.col("_n") - 1) / F.lit(float(DAY_US))).otherwise(F.lit(0.0)).alias("mean_gap_days"),
        F.when(F.col("_pairs") > 0, F.exp(-(F.col("_delta") / F.col("_pairs") / F.lit(float(DAY_US))) / F.lit(RELAY_DECAY_DAYS))).otherwise(F.lit(0.0)).alias("relay_score"),
    )


def span_days(tx: DataFrame) -> DataFrame:
    """One row: days between the first and last transaction, 1 at least."""
    return tx.agg(F.greatest((F.max(_micros("timestamp")) - F.min(_micros("timestamp"))) / F.lit(float(DAY_US)), F.lit(1.0)).alias("span_days"))


def velocity(counts: DataFrame, tx: DataFrame, window_days: int = 7) -> DataFrame:
    """Transactions per window over the whole span; counts has account and tx_count."""
    return counts.crossJoin(F.broadcast(span_days(tx))).withColumn("velocity_7d", F.col("tx_count") / F.greatest(F.col("span_days") / F.lit(float(window_days)), F.lit(1.0))).drop("span_days")


def all_accounts(tx: DataFrame) -> DataFrame:
    return tx.select(F.explode(F.array("from_account", "to_account")).alias("account")).distinct()


def account_labels(tx: DataFrame) -> DataFrame:
    """account, label: 1 for either side of a laundering transaction. No labels at all: no rows."""
    known = F.max(F.col("is_laundering").isNotNull().cast("int"))
    rows = tx.select(F.explode(F.array("from_account", "to_account")).alias("account"), "is_laundering")
    per = rows.groupBy("account").agg(F.max(F.coalesce((F.col("is_laundering") == 1).cast("int"), F.lit(0))).alias("label"))
    return per.crossJoin(F.broadcast(tx.agg(known.alias("_any")))).where("_any = 1").drop("_any")


def daily_volume(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.to_date("timestamp").alias("date")).agg(F.sum("amount_received").alias("amount_received"))


def laundering_only(tx: DataFrame) -> DataFrame:
    return tx.where("is_laundering = 1")


def ratios(features: DataFrame) -> DataFrame:
    """Add the derived ratio and balance columns."""
    c = F.col
    flow = c("incoming_amount_total") / (c("outgoing_amount_total") + 1.0)
    return features.withColumns(
        {
            "in_out_degree_ratio": c("in_degree") / (c("out_degree") + 1.0),
            "in_out_amount_ratio": flow,
            "cashflow_ratio": flow,
            "fanout_ratio": c("unique_out_counterparties") / (c("unique_in_counterparties") + 1.0),
            "degree_balance": F.abs(c("in_degree") - c("out_degree")),
            "amount_balance": F.abs(c("incoming_amount_total") - c("outgoing_amount_total")),
        }
    )


def both_flows(tx: DataFrame) -> DataFrame:
    """flow_stats of both sides with tx_count, one row an account; 0 on a side without transactions. Columns that nobody asks for are never aggregated."""
    out = flow_stats(tx, "outgoing").join(flow_stats(tx, "incoming"), "account", "full")
    numbers = [n for n, t in out.dtypes if t in ("double", "bigint")]
    return out.fillna(0, subset=numbers).withColumn("tx_count", F.col("outgoing_tx_count") + F.col("incoming_tx_count"))


def flow_features(tx: DataFrame, window_days: int = 7) -> DataFrame:
    """Features from the flows of either side alone; degrees are the distinct counterparties."""
    out = velocity(both_flows(tx), tx, window_days).withColumns(
        {
            "in_degree": F.col("unique_in_counterparties"),
            "out_degree": F.col("unique_out_counterparties"),
            "weighted_in_degree": F.col("incoming_amount_total"),
            "weighted_out_degree": F.col("outgoing_amount_total"),
            "weighted_degree": F.col("incoming_amount_total") + F.col("outgoing_amount_total"),
            "total_unique_counterparties": F.col("unique_in_counterparties") + F.col("unique_out_counterparties"),
            "is_isolated": ((F.col("unique_in_counterparties") == 0) & (F.col("unique_out_counterparties") == 0)).cast("long"),
        }
    )
    return ratios(out).drop("outgoing_tx_count", "incoming_tx_count", "outgoing_amount_max", "incoming_amount_max")


def tabular_features(tx: DataFrame, window_days: int = 7) -> DataFrame:
    """Features that need no graph algorithm, one row an account."""
    return flow_features(tx, window_days).join(timing_stats(tx), "account", "left").fillna(0, subset=["max_gap_days", "mean_gap_days", "relay_score"])
