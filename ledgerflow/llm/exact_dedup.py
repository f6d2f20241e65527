"""Exact dedup on DataFrame functions only.

Texts are equal when identical after white space [\\x20\\x09-\\x0D] is deleted.
Every text is hashed once, to a narrow table of digests. Rows group by a 128-bit
content hash; only the texts of hashes seen more than once are read again, and
inside a hash group the normalised bytes themselves are the key, so a collision
never joins two texts. That aggregation combines on the map side first: a group
that holds a third of all rows reaches the shuffle as one text a task. Beyond
REPEATED such hashes their filter would cost a shuffle of texts itself, and all
texts are grouped; results are the same. Rows get their group back by a narrow
join on digests, which AQE splits where one key is hot.

Null text counts as empty; empty texts form one group. A row with a null id never
stays while its group has another: null ids come last, however long the text.
Repeated rows (also of one id) are members like any other; of one id's rows those
of the greatest length are marked as kept, so rows alike are all marked. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import narrow, written

SPACES = " \t\n\x0b\x0c\r"
_ID_SPAN = "18446744073709551616"  # 2^64: ids fit below the length in one decimal
_ID_MAX = "9223372036854775807"
REPEATED = 250_000  # digests that are broadcast at most: some 100 bytes each


def normalised(text: str):
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def _digests(df: DataFrame, text: str, key: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("_id"), normalised(text).alias("_norm"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_len"))
    return written(rows.select("_id", "_len", F.unhex(F.md5("_norm")).alias("_md5"), F.unhex(F.sha2("_norm", 256)).alias("_sha")), "digests")


def _marked(df: DataFrame, digests: DataFrame, text: str, key: str) -> DataFrame:
    """The digests with keep_id, group_size and kept."""
    repeated = written(digests.groupBy("_md5").count().where("count > 1").select("_md5"), "repeated-digests")
    rows = df.select(F.col(key).cast("long").alias("_id"), normalised(text).alias("_norm"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_len")).withColumn("_md5", F.unhex(F.md5("_norm")))
    if repeated.count() <= REPEATED:
        rows = rows.join(F.broadcast(repeated), "_md5", "left_semi")
    # One comparable number for (length, smaller id first): a decimal buffer keeps the aggregation a hash aggregation.
    rank = F.expr(f"cast(_len as decimal(12,0)) * {_ID_SPAN}BD + ({_ID_MAX}BD - cast(_id as decimal(20,0)))")
    classes = (
        rows.select("_md5", "_norm", rank.cast("decimal(38,0)").alias("_rank"))
        .groupBy("_md5", "_norm")
        .agg(F.count(F.lit(1)).alias("_size"), F.max("_rank").alias("_best"))
        .select(
            "_md5",
            F.unhex(F.sha2("_norm", 256)).alias("_sha"),
            "_size",
            F.expr(f"cast({_ID_MAX}BD - pmod(_best, {_ID_SPAN}BD) as long)").alias("_keep"),
            F.expr(f"cast(_best div {_ID_SPAN}BD as int)").alias("_longest"),
        )
    )
    alone = F.col("_size").isNull()
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_longest").isNull() | (F.col("_len") == F.col("_longest")))
    return digests.join(classes, ["_md5", "_sha"], "left").select(
        "_id", "_sha", F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", F.lit(1)).alias("group_size"), (alone | stays).alias("kept")
    )


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the
    smallest id (nulls last).
    """
    rows = _marked(df, _digests(df, text, key), text, key)
    return rows.select(F.col("_id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with all their columns: one row of each group, also where an id repeats."""
    digests = _digests(df, text, key)
    marked = written(_marked(df, digests, text, key).select("_id", "_sha", "kept"), "exact-marked")
    if digests.groupBy("_id").count().where("count > 1").isEmpty():  # an id names a row: the few that go are taken out, and texts stay where they are
        gone = narrow(written(marked.where("not kept").select(F.col("_id").alias("__gone")), "exact-gone"))
        return df.join(gone, F.col(key).cast("long").eqNullSafe(F.col("__gone")), "left_anti").select(df.columns)
    by_text = marked.groupBy(F.col("_id").alias("__kept_id"), F.col("_sha").alias("__kept_sha")).agg(F.count(F.lit(1)).alias("__rows"), F.max("kept").alias("__kept")).where("__kept")
    keep = written(by_text.drop("__kept"), "exact-kept")
    sha = F.unhex(F.sha2(normalised(text), 256))
    same = F.col(key).cast("long").eqNullSafe(F.col("__kept_id")) & (sha == F.col("__kept_sha"))
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    order = Window.partitionBy(F.col(key), sha).orderBy(size.desc(), F.col(text))
    first = df.join(keep.where("__rows > 1"), same, "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return df.join(keep.where("__rows = 1"), same, "left_semi").unionByName(first).select(df.columns)
