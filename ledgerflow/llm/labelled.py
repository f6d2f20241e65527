"""Bounded samples of labelled texts to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_bucket


def sample_labelled(df: DataFrame, labels: DataFrame, grade: str, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _text, _grade, _fold) of labelled rows that are not held out, about most of them, chosen by hash of the id; _fold is 0 to 9 by another hash.

    Null ids and grades have no label; an id graded more than once keeps its
    least grade. Only ids and grades are read to size the sample; the semi-join
    side it leaves is bounded by most.
    """
    graded = labels.where(F.col(grade).isNotNull() & F.col(key).isNotNull() & (crc_bucket(key) != 2)).groupBy(F.col(key).alias("_id")).agg(F.min(grade).alias("_grade"))
    n = graded.count()
    share = min(1_000_000, int(1_000_000 * most / max(1, n)))
    chosen = graded.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share)
    texts = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if share * n <= 2 * most * 1_000_000:  # a checked size: a few bytes a row
        chosen = F.broadcast(chosen)
    return texts.join(chosen, "_id").withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(10)).cast("int"))
