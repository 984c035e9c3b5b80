"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import cut, shared_dir

#: Stands in for a null id: such rows come after all others.
LAST_ID = (1 << 63) - 1
#: Ids in a list that is broadcast whole, 8 bytes each; longer lists are joined by merging.
MOST_IDS = 2_000_000
#: Bytes of a batch that is sent to a worker; batches() puts them together as an operator wants them.
SENT_BYTES = 1 << 20
_SENT, _SENT_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

__all__ = ["LAST_ID", "batches", "cut", "fresh_dir", "give_back", "id_key", "map_arrow", "map_rows", "of_ids", "remove_dir", "row_key", "shared_dir", "table", "texts", "with_small_batches", "without_ids", "without_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; Spark creates it when it writes."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that fresh_dir named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_key(column: str = "doc_id") -> Column:
    """A never-null join key for an id."""
    return F.coalesce(F.col(column), F.lit(LAST_ID).cast("long"))


def _joined(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    ids = cut(ids.select(F.col(ids.columns[0]).cast("long").alias("__id")).where("__id IS NOT NULL").distinct())
    listed = F.broadcast(ids) if ids.count() <= MOST_IDS else ids.hint("merge")
    return rows.join(listed, id_key(column) == F.col("__id"), how)


def of_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id (LAST_ID for null) is in the first column of ids; texts are shuffled only for a list longer than MOST_IDS."""
    return _joined(rows, ids, column, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id (LAST_ID for null) is not in the first column of ids."""
    return _joined(rows, ids, column, "left_anti")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by its id and text: rows that share an id are told apart, rows equal in both are one."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of documents whose row_key is not in the first column of keys."""
    return _joined(rows.withColumn("__row", row_key()), keys, "__row", "left_anti").drop("__row")


def batches(iterator: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches near most_bytes, but not above (one row at least): small batches are put together, large ones split."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in iterator:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            part = batch.slice(start, min(step, rows - start))
            if waiting and held + part.nbytes > most_bytes:
                whole, waiting, held = _together(waiting), [], 0
                yield whole
            waiting.append(part)
            held += part.nbytes
    if waiting:
        yield _together(waiting)


def _together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for other stages, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Bound batches on their way to the workers by SENT_BYTES, unless the session has a bound of its own: both sides keep whole batches outside the heap.

    For applications, which own their session: the registered queries and the pipeline; operators leave settings alone.
    """
    if spark.conf.get(_SENT) == _SENT_DEFAULT:
        spark.conf.set(_SENT, str(SENT_BYTES))
    return spark


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow, after which a task leaves no memory behind in its worker."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(iterator)
        give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_bytes: int = 16 << 20) -> DataFrame:
    """mapInArrow with a function of one bounded batch."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, most_bytes):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)
