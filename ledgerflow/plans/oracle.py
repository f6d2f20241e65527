"""DuckDB SQL twins of the registered queries, over the same parquet tables."""

from __future__ import annotations

from ..functions.risk import PHRASES
from ..sources.sample_view import DUCKDB
from .queries import EXPLAINED, POWER_ROUNDS


def _r(expression: str, name: str | None = None) -> str:
    return f"{_rounded(expression)} as {name or expression}"


def _rounded(x: str) -> str:
    return f"case when ({x}) = 0 then 0.0 when abs({x}) >= 1000 then round({x} + 1e-7, 3) else round({x} + 1e-9, 6) end"


def _rs(*names: str) -> str:
    return ", ".join(_r(n) for n in names)


def _with(body: str, *ctes: str) -> str:
    return f"with recursive tx as ({DUCKDB})" + "".join(f", {c}" for c in ctes) + f"\n{body}"


def _side(side: str) -> str:
    own, other, unique = ("from_account", "to_account", "unique_out_counterparties") if side == "outgoing" else ("to_account", "from_account", "unique_in_counterparties")
    return f"""{side} as (
      select account, sum(v) as {side}_amount_total, avg(v) as {side}_amount_mean, coalesce(stddev_samp(v), 0.0) as {side}_amount_std,
        count(*) as {side}_tx_count, max(v) as {side}_amount_max, count(distinct other) as {unique},
        max(v) / (sum(v) + 1e-9) as {side}_concentration, -sum(case when v > 0 then v / s * log2(v / s) else 0 end) as {side}_entropy
      from (select {own} as account, {other} as other, amount_received as v, sum(amount_received) over (partition by {own}) as s from tx) group by account)"""


OUT, IN = _side("outgoing"), _side("incoming")
LINE = "line as (select from_account as account, timestamp as t, true as is_out from tx union all select to_account, timestamp, false from tx)"
GAPS = """gaps as (
  select account, coalesce(max(g), 0) as max_gap_days, coalesce(avg(g), 0) as mean_gap_days
  from (select account, (epoch_us(t) - lag(epoch_us(t)) over (partition by account order by t)) / 86400e6 as g from line) group by account)"""
RELAY = """relay as (
  select account, coalesce(exp(-avg(d) / 3.0), 0.0) as relay_score from (
    select account, case when not is_out then (min(case when is_out then epoch_us(t) end) over (partition by account order by epoch_us(t) range between current row and unbounded following) - epoch_us(t)) / 86400e6 end as d from line)
  group by account)"""
SPAN = "span as (select greatest((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6, 1.0) as days from tx)"
ACCOUNTS = "accounts as (select from_account as account from tx union select to_account from tx)"
LABELS = "account_label as (select account, max(l)::int as label from (select from_account as account, is_laundering as l from tx union all select to_account, is_laundering from tx) group by account)"
_ZERO = ["outgoing_amount_total", "outgoing_amount_mean", "outgoing_amount_std", "unique_out_counterparties", "outgoing_concentration", "outgoing_entropy", "incoming_amount_total", "incoming_amount_mean", "incoming_amount_std", "unique_in_counterparties", "incoming_concentration", "incoming_entropy"]
FEATURES = f"""base as (
  select a.account, {", ".join(f"coalesce({c}, 0) as {c}" for c in _ZERO)}, max_gap_days, mean_gap_days, relay_score,
    (coalesce(outgoing_tx_count, 0) + coalesce(incoming_tx_count, 0))::bigint as tx_count, days
  from accounts a left join outgoing using (account) left join incoming using (account) left join gaps using (account) left join relay using (account), span),
features as (
  select * exclude (days), tx_count / greatest(days / 7.0, 1.0) as velocity_7d,
    unique_in_counterparties as in_degree, unique_out_counterparties as out_degree,
    incoming_amount_total as weighted_in_degree, outgoing_amount_total as weighted_out_degree, incoming_amount_total + outgoing_amount_total as weighted_degree,
    unique_in_counterparties + unique_out_counterparties as total_unique_counterparties, (unique_in_counterparties + unique_out_counterparties = 0)::bigint as is_isolated,
    unique_in_counterparties / (unique_out_counterparties + 1.0) as in_out_degree_ratio, incoming_amount_total / (outgoing_amount_total + 1.0) as in_out_amount_ratio,
    incoming_amount_total / (outgoing_amount_total + 1.0) as cashflow_ratio, unique_out_counterparties / (unique_in_counterparties + 1.0) as fanout_ratio,
    abs(unique_in_counterparties - unique_out_counterparties) as degree_balance, abs(incoming_amount_total - outgoing_amount_total) as amount_balance
  from base)"""
FLOW = (LINE, ACCOUNTS, OUT, IN, GAPS, RELAY, SPAN, FEATURES)
_COUNTS = ("unique_out_counterparties", "unique_in_counterparties", "tx_count", "in_degree", "out_degree", "total_unique_counterparties", "is_isolated", "degree_balance")
_DOUBLES = [c for c in _ZERO if c not in _COUNTS] + ["max_gap_days", "mean_gap_days", "relay_score", "velocity_7d", "weighted_in_degree", "weighted_out_degree", "weighted_degree", "in_out_degree_ratio", "in_out_amount_ratio", "cashflow_ratio", "fanout_ratio", "amount_balance"]
_ALL = ", ".join([f"{c}::bigint as {c}" for c in _COUNTS]) + ", " + _rs(*_DOUBLES)

RAW = """raw as (
  select account, outgoing_amount_total / (outgoing_amount_total + incoming_amount_total + 1.0) as p, outgoing_amount_total + incoming_amount_total as a from features)"""
SCORED = f"""scored0 as (
  select account, {_r("p", "supervised_probability")}, {_r("(a - low) / (high - low)", "anomaly_score")}, {_r("0.8 * p + 0.2 * ((a - low) / (high - low))", "risk_score")}
  from raw, (select min(a) as low, max(a) as high from raw)),
cut as (select quantile_cont(risk_score, 0.95) as medium, quantile_cont(risk_score, 0.99) as high from scored0),
scored as (select *, case when risk_score <= medium then 'Low' when risk_score <= high then 'Medium' else 'High' end as risk_tier from scored0, cut)"""
PROXY = (*FLOW, RAW, SCORED)
MATCHED = "m as (select risk_score as p, label as y from scored join account_label using (account))"
EDGES = "edges as (select from_account as src, to_account as dst, sum(amount_received) as amount, count(*) as count from tx group by all)"
UND = "u as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst), adj as (select a as v, b as w from u union all select b, a from u)"
TRI = "tri as (select x.v as account, count(*) as t from adj x join adj y on x.v = y.v and x.w < y.w join u on u.a = x.w and u.b = y.w group by x.v), deg as (select v as account, count(*) as d from adj group by v)"
CLUSTER = "cl as (select account, case when d >= 2 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0.0 end as c from accounts left join deg using (account) left join tri using (account))"
DENSITY = """near as (select v as account, w as member from adj union select src, src from edges where src = dst),
  members as (select * from near union select account, account from accounts),
  pairs as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges),
  inside as (select x.account, count(*) as e from members x join members y on x.account = y.account and x.member <= y.member join pairs on pairs.a = x.member and pairs.b = y.member group by x.account),
  sizes as (select account, count(*) as k from members group by account), nears as (select account, count(*) as n from near group by account),
  density as (select account, case when coalesce(n, 0) > 1 and n <= 100 then e / greatest(k * (k - 1) / 2.0, 1.0) else c end as local_density
    from cl join sizes using (account) left join nears using (account) left join inside using (account))"""
_POWER = "nb as (select distinct src, dst from (select src, dst from edges union select dst, src from edges)), x0 as (select account, 1.0::double as x from accounts)" + "".join(
    f", x{k} as (select account, sum(x) as x from (select account, x from x{k - 1} union all select dst, x from nb join x{k - 1} on account = src) group by account)" for k in range(1, POWER_ROUNDS + 1)
)
REACH = "reach(a, b) as (select src, dst from edges where src <> dst union select r.a, e.dst from reach r join edges e on e.src = r.b where e.src <> e.dst)"
DIRTY = """dirty as (select tx_id, case when tx_id % 28 = 0 then null when tx_id % 3 = 0 then date_trunc('minute', timestamp) else date_trunc('second', timestamp) end as timestamp,
  case when tx_id % 20 = 0 then 'nan' else from_account end as from_account,
  case when tx_id % 44 = 0 or tx_id % 52 = 0 then 0.0 else amount_received end as r, case when tx_id % 12 <> 0 then amount_paid end as p,
  case when tx_id % 36 = 0 or tx_id % 32 = 0 or tx_id % 16 = 0 then 0 else is_laundering end::int as is_laundering from tx), kept as (select * from dirty where timestamp is not null)"""
LONG = f"long as (select account, feature, value from (select account, {', '.join(f'({_rounded(c + "::double")})::double as {c}' for c in EXPLAINED)} from features) unpivot (value for feature in ({', '.join(EXPLAINED)})))"
MAD = """mid as (select feature, median(value) as median from long group by feature),
  mad as (select feature, any_value(mid.median) as median, median(abs(value - mid.median)) as m from long join mid using (feature) group by feature),
  devs as (select feature, median, case when m = 0 then 1e-9 else m end as mad from mad)"""
RANKED = """z as (select account, feature, value, median, abs((value - median) / mad) as deviation from long join devs using (feature)),
  ranked as (select *, row_number() over (partition by account order by deviation desc, feature) as rank, case when value >= median then 'high' else 'low' end as direction from z)"""
_PHRASE = "case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in PHRASES.items()) + " else replace(feature, '_', ' ') end"
BY_SCORE = """g as (select p, sum(y) as pos, sum(1 - y) as neg from m group by p),
  c as (select p, pos, neg, sum(pos) over w as cp, sum(neg) over w as cn from g window w as (order by p desc rows between unbounded preceding and current row))"""
_AUC = "sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg))"
_AP = "sum(pos * cp / (cp + cn)) / sum(pos)"
# Power steps over neighbours and the node itself, until the summed change is small; none is 0 at the end only if that took over 200 steps.
POWER = """nbs as (select distinct src, dst, false as own from (select src, dst from edges union select dst, src from edges) union all select account, account, true from accounts),
  size as (select count(*) as n from accounts),
  power(k, account, x, change) as (
    select 0, account, 1.0::double / n, 1e300::double from accounts, size
    union all
    select k + 1, account, y / norm, sum(abs(y / norm - old)) over () from (
      select any_value(k) as k, dst as account, sum(x) as y, sum(case when own then x end) as old, sqrt(sum(sum(x) * sum(x)) over ()) as norm
      from power join nbs on src = account, size where change >= n * 1e-4 and k < 200 group by dst))"""
# Walks of each length give distances, distances give the shortest paths, and a node is between s and t if its distances add up.
PATHS = """links as (select src, dst from edges where src <> dst),
  walk(s, v, d) as (select account, account, 0 from accounts union select s, dst, d + 1 from walk join links on src = v where d < 50),
  dist as (select s, v, min(d) as d from walk group by s, v),
  paths(s, v, d, p) as (
    select account, account, 0, 1.0::double from accounts
    union all
    select p.s, e.dst, p.d + 1, sum(p.p) from paths p join links e on e.src = p.v join dist t on t.s = p.s and t.v = e.dst and t.d = p.d + 1 group by p.s, e.dst, p.d),
  between_ as (
    select a.v as account, sum(a.p * b.p / c.p) as x
    from paths a join paths b on b.s = a.v join paths c on c.s = a.s and c.v = b.v and c.d = a.d + b.d
    where a.s <> a.v and b.s <> b.v and a.s <> b.v group by a.v)"""
CONF = "conf as (select count(*) filter (y = 0 and p < 0.5) as tn, count(*) filter (y = 0 and p >= 0.5) as fp, count(*) filter (y = 1 and p < 0.5) as fn, count(*) filter (y = 1 and p >= 0.5) as tp from m)"
SCORES = (*PROXY, LABELS, MATCHED)

ORACLES = {
    "scan_transactions": _with("select tx_id, timestamp, from_bank, from_account, to_bank, to_account, round(amount_received, 6) as amount_received, round(amount_paid, 6) as amount_paid, payment_format, is_laundering::int as is_laundering from tx"),
    "clean_timestamps": _with("select tx_id, timestamp from kept", DIRTY),
    "clean_amounts": _with("select tx_id, round(r, 6) as amount_received, round(coalesce(p, r), 6) as amount_paid from kept", DIRTY),
    "clean_strings": _with("select tx_id, from_account from kept", DIRTY),
    "clean_labels": _with("select tx_id, is_laundering from kept", DIRTY),
    "laundering_tx": _with("select tx_id, from_account, to_account, round(amount_received, 6) as amount_received from tx where is_laundering = 1"),
    "time_split": _with("select tx_id, case when p < floor(n * 0.6) then 'train' when p < floor(n * (0.6 + 0.2)) then 'val' else 'test' end as part from (select tx_id, row_number() over (order by timestamp, tx_id) - 1 as p, count(*) over () as n from tx)"),
    "outgoing_stats": _with(f"select account, {_rs('outgoing_amount_total', 'outgoing_amount_mean', 'outgoing_amount_std', 'outgoing_amount_max')}, outgoing_tx_count from outgoing", OUT),
    "incoming_stats": _with(f"select account, {_rs('incoming_amount_total', 'incoming_amount_mean', 'incoming_amount_std', 'incoming_amount_max')}, incoming_tx_count from incoming", IN),
    "counterparties": _with("select account, unique_out_counterparties, unique_in_counterparties, total_unique_counterparties from features", *FLOW),
    "concentration": _with(f"select account, {_rs('outgoing_concentration', 'incoming_concentration')} from features", *FLOW),
    "amount_entropy": _with(f"select account, {_rs('outgoing_entropy', 'incoming_entropy')} from features", *FLOW),
    "gap_stats": _with(f"select account, {_rs('max_gap_days', 'mean_gap_days')} from gaps", LINE, GAPS),
    "relay_score": _with(f"select account, {_rs('relay_score')} from relay", LINE, RELAY),
    "velocity": _with(f"select account, tx_count, {_rs('velocity_7d')} from features", *FLOW),
    "ratios": _with(f"select account, {_rs('in_out_degree_ratio', 'in_out_amount_ratio', 'cashflow_ratio', 'fanout_ratio', 'amount_balance')}, degree_balance::bigint as degree_balance from features", *FLOW),
    "all_accounts": _with("select account from accounts", ACCOUNTS),
    "account_labels": _with("select account, label from account_label", LABELS),
    "class_balance": _with("select sum(label)::bigint as positives, sum(1 - label)::bigint as negatives, count(distinct label) as classes, round(greatest(sum(1 - label) / greatest(sum(label), 1), 1.0), 6) as scale_pos_weight from account_label", LABELS),
    "daily_volume": _with("select timestamp::date::varchar as date, round(sum(amount_received) + 1e-9, 6) as amount_received from tx group by 1"),
    "account_features_tabular": _with(f"select account, {_ALL} from features", *FLOW),
    "labeled_features": _with(f"select account, {_ALL}, label from features join account_label using (account)", *FLOW, LABELS),
    "edge_aggregate": _with("select src, dst, round(amount, 6) as amount, count from edges", EDGES),
    "edge_history": _with("select from_account as src, to_account as dst, count(*) as count, string_agg(printf('%.2f', amount_received), '|' order by timestamp, tx_id) as amounts, string_agg(payment_format, '|' order by timestamp, tx_id) as payment_formats from tx group by 1, 2"),
    "node_order": _with("select account, row_number() over (order by side, k) - 1 as node_idx from (select account, min(side) as side, arg_min(tx_id, (side, tx_id)) as k from (select from_account as account, 0 as side, tx_id from tx union all select to_account, 1, tx_id from tx) group by account)"),
    "undirected_edges": _with("select a, b from u", EDGES, UND),
    "degrees": _with("select account, (select count(*) from edges where dst = account) as in_degree, (select count(*) from edges where src = account) as out_degree from accounts", ACCOUNTS, EDGES),
    "clustering": _with(f"select account, {_r('c', 'clustering_coefficient')} from cl", ACCOUNTS, EDGES, UND, TRI, CLUSTER),
    "local_density": _with(f"select account, {_rs('local_density')} from density", ACCOUNTS, EDGES, UND, TRI, CLUSTER, DENSITY),
    "short_cycle_score": _with("select account, coalesce(n, 0)::double as short_cycle_score from accounts left join (select r.a as account, count(*) as n from reach r join reach q on r.a = q.b and r.b = q.a where r.a <> r.b group by r.a) using (account)", ACCOUNTS, EDGES, REACH),
    "eigenvector_k": _with(f"select account, {_r('x / sqrt(q)', 'x')} from x{POWER_ROUNDS}, (select sum(x * x) as q from x{POWER_ROUNDS})", ACCOUNTS, EDGES, _POWER),
    "eigenvector": _with(f"select account, {_r('case when change < n * 1e-4 then x else 0.0 end', 'eigenvector_centrality')} from power, size where k = (select max(k) from power)", ACCOUNTS, EDGES, POWER),
    "betweenness_exact": _with(f"select account, {_r('coalesce(x, 0) / greatest((n - 1) * (n - 2), 1)', 'betweenness_centrality')} from accounts left join between_ using (account), (select count(*) as n from accounts)", ACCOUNTS, EDGES, PATHS),
    "downsample": _with("select tx_id, 1 as is_laundering from tx where is_laundering = 1 union all select tx_id, 0 from (select tx_id, row_number() over (order by md5(concat(tx_id::varchar, ':42')), tx_id) as r from tx where is_laundering = 0) where r <= 5 * (select count(*) from tx where is_laundering = 1)"),
    "minmax_scale": _with("select account, anomaly_score from scored", *PROXY),
    "risk_blend": _with("select account, risk_score from scored", *PROXY),
    "risk_thresholds": _with("select round(medium, 6) as medium, round(high, 6) as high from cut", *PROXY),
    "risk_tier": _with("select account, risk_tier from scored", *PROXY),
    "tier_counts": _with("select tier, count(account) as accounts from (values ('High'), ('Medium'), ('Low')) t(tier) left join scored on risk_tier = tier group by tier", *PROXY),
    "portfolio_summary": _with("select (select count(*) from tx) as transactions, count(*) as accounts, count(*) filter (risk_tier = 'High') as flagged_high, count(*) filter (risk_tier = 'Medium') as flagged_medium from scored", *PROXY),
    "alert_feed": _with("select account, risk_score, risk_tier, supervised_probability, anomaly_score from scored where risk_tier in ('Medium', 'High') order by risk_score desc, account limit 50", *PROXY),
    "risk_curve": _with("select row_number() over (order by risk_score, account) - 1 as position, risk_score from scored", *PROXY),
    "safe_quantile": _with("select round(quantile_cont(amount_received, 0.9), 6) as quantile from tx"),
    "classification_metrics": _with(
        f"""select round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall,
          round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1, round(auc, 6) as roc_auc, round(ap, 6) as pr_auc from conf, (select {_AUC} as auc, {_AP} as ap from c)""",
        *SCORES, CONF, BY_SCORE,
    ),
    "confusion_matrix": _with("select tn, fp, fn, tp from conf", *SCORES, CONF),
    "roc_auc": _with(f"select round({_AUC}, 6) as roc_auc from c", *SCORES, BY_SCORE),
    "average_precision": _with(f"select round({_AP}, 6) as average_precision from c", *SCORES, BY_SCORE),
    "metric_table": _with(
        f"""select unnest(['Precision', 'Recall', 'F1 Score', 'ROC AUC', 'PR AUC']) as metric,
          unnest([round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6), round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6), round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6), round(auc, 6), round(ap, 6)]) as value
          from conf, (select {_AUC} as auc, {_AP} as ap from c)""",
        *SCORES, CONF, BY_SCORE,
    ),
    "confusion_table": _with("select 'Actual Non-Laundering' as actual, tn as predicted_non_laundering, fp as predicted_laundering from conf union all select 'Actual Laundering', fn, tp from conf", *SCORES, CONF),
    "feature_mad": _with(f"select feature, {_r('median')}, {_r('mad')} from devs", *FLOW, LONG, MAD),
    "explain_mad": _with("select account, rank::int as rank, feature, direction, round(deviation, 4) as deviation from ranked where rank <= 3", *FLOW, LONG, MAD, RANKED),
    "reason_text": _with(f"select account, concat({_PHRASE}, ' (', direction, ' than the portfolio median)') as reason from ranked where rank = 1", *FLOW, LONG, MAD, RANKED),
}
