"""Folders that driver and executors share, and tables written there.

Lineage is cut with written tables, so a lost executor costs a re-read and
not a recomputation of everything before.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import work_dir, written

__all__ = ["written"]


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for one run's files; two runs never share one."""
    return f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"


BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if its counted rows stay within BROADCAST_ROWS (tens of MB), else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A pyarrow file system and the path in it, for a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write chunks under a name of this attempt's own, then rename: readers and retried tasks never see half a file."""
    where, path = file_system(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with where.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    where.move(part, path)
    return size


BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_transfers(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes: texts are long, and each batch is held by the JVM and by Python at once. Spark reads these settings when a plan first runs, which may be after the operator has returned, so they stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with batches of a few rows' text: function gets pyarrow record batches and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_transfers(df.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for out in function(batches):
            yield pa.record_batch([v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def small_batches(batches, rows: int = 512) -> Iterator:
    """Cut record batches so that the working set of a Python worker follows a few hundred texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_bucket(column: str):
    """crc32 of the id as text, modulo 4: rows where it is 2 are held out from every model."""
    return F.crc32(F.col(column).cast("string")) % 4


_kept: dict[str, object] = {}


def kept(token: str, make):
    """The object of that token, made once a Python process; those live across tasks and stages, so only the last one is held and its memory given back."""
    if token not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[token] = make()
    return _kept[token]
