"""Arriving transaction files through the batch cleaning plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import canonical_headers
from ..sources.transactions import clean


def stream_transactions(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A streaming frame of cleaned transactions from CSV files with the given header; positions in time need a batch, so there is no tx_id."""
    names = canonical_headers(header)
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    return clean(spark.readStream.schema(schema).option("header", True).csv(path).toDF(*names))
