"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..sources.shared import bounded_batches, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of the text contracts: runs of anything but ASCII characters that are not digits or letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Groups above one thousandth of all rows are hot, so fewer than this many groups can be.
HOT_GROUPS = 1000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII alone takes Spark's fast lower(); null stays null."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pitchflow/{name}-{uuid.uuid4().hex}"


def arrow_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a table. They go by Arrow, as for pickled rows each executor starts a second set of workers, which stays."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return spark.createDataFrame(table) if rows else spark.createDataFrame([], from_arrow_schema(schema))


def trimmed(rows: Iterator[pa.RecordBatch | pa.Array]) -> Iterator[pa.RecordBatch | pa.Array]:
    """The rows of a task; after them its worker, which is kept for other tasks, gives back the memory that it freed."""
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # of glibc alone
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read back. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], size: str, total: int | None = None) -> DataFrame:
    """Inner join to `right`, which has one row for each key and in `size` the number of rows of `left` with it.

    Keys with over a thousandth of all rows are fewer than HOT_GROUPS whatever the input, so those rows of
    `right` are broadcast and the rows of `left` under them stay where they are; the rest is shuffled. total: the number
    of rows of `left`, if it is known near enough.
    """
    keys = [key] if isinstance(key, str) else key
    total = (right.agg(F.sum(size)).first()[0] or 0) if total is None else total
    limit = total // HOT_GROUPS + 1
    hot = F.broadcast(right.where(F.col(size) > limit))
    rest = left.join(F.broadcast(right.where(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(F.col(size) <= limit), keys))
