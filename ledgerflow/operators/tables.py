"""Written tables between iterations, and global row numbers without a one-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a fresh local one only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerflow-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add the global position (from 0) in the given order.

    Rows are range-partitioned and numbered within partitions; the offsets are
    one count a partition. No task sees more than its range. order must be a
    total order for the numbers to be defined.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    table = written(ranged, "ranged")
    part = F.shiftright("_m", 33)
    sizes = table.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    # One row a partition of the range exchange, so this window is small.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", (F.col("_before") - F.col("_first")).alias("_shift"))
    return table.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(out, (F.col("_m") + F.col("_shift")).cast("long")).drop("_p", "_m", "_shift")
