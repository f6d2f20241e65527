"""Exact quantiles by linear interpolation, for any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered

ONE_TASK_ROWS = 2_000_000


def quantiles(rows: DataFrame, qs: list[float], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """key, quantiles (an array in the order of qs) of rows (key, value); null and NaN values are left out.

    The built-in exact percentile keeps a key's values in one task, so beyond
    one_task_rows rows are range-sorted instead and picked by position.
    """
    rows = rows.where("value is not null and not isnan(value)").select("key", F.col("value").cast("double").alias("value"))
    if rows.count() <= one_task_rows:
        return rows.groupBy("key").agg(F.percentile("value", F.array(*[F.lit(q) for q in qs])).alias("quantiles"))
    placed = numbered(rows, ["key", "value"], "_at")
    spans = placed.groupBy("key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    wanted = spans.select("key", "_first", F.posexplode(F.array(*[F.lit(q) * (F.col("_n") - 1) for q in qs])).alias("_k", "_rank"))
    ends = wanted.select("key", "_k", "_rank", F.explode(F.array(F.floor("_rank"), F.ceil("_rank"))).alias("_r"), "_first")
    hits = placed.join(F.broadcast(ends.select("key", "_k", "_rank", (F.col("_r") + F.col("_first")).alias("_at"))), ["key", "_at"])
    each = hits.groupBy("key", "_k").agg((F.min("value") + (F.max("value") - F.min("value")) * F.max(F.col("_rank") - F.floor("_rank"))).alias("v"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]).alias("quantiles"))
