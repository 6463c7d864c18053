"""What several operators here need: reading tables, Arrow columns, working names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

import lakeward
from lakeward.session import tune

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package's code to the Python workers, once per application.

    Functions that run in tasks are pickled by reference, and nothing says that
    the machines of a cluster have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(lakeward.__file__).parent
    # Spark's driver serves the file to the executors for as long as it runs.
    path = os.path.join(tempfile.mkdtemp(prefix="lakeward-code-"), "lakeward_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read by Spark alone, so any store Spark knows will do."""
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def give_back_memory() -> None:
    """Return what a worker has freed to the system, at the end of a task.

    Workers are reused, also by stages that need none of it, and what they keep
    counts against their executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def map_batches(
    df: DataFrame,
    one: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | T.StructType,
    rows: int | None = None,
) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch.

    Spark bounds a batch in rows and bytes; ``rows`` cuts it further where the
    result of a batch is much larger than the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows or 1):
                out = one(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        give_back_memory()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.Array], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``keep`` accepts by their text, with all their columns and no shuffle."""
    at = df.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return map_batches(df, one, df.schema)


def with_text_key(
    df: DataFrame, name: str, key: Callable[[bytes | None], int], text_col: str = "text"
) -> DataFrame:
    """``df`` with a new long column ``name``: ``key`` of the bytes of the text."""
    at = df.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([key(t) for t in utf8(batch.column(at))], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, name])

    return map_batches(df, one, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def id_remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; the fold of a document."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % divisor
