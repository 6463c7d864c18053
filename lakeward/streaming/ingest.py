"""Incremental ingestion of arriving files with Structured Streaming.

The chunk loop of a batch reader becomes a file stream: every micro-batch is
validated, stamped and written as its own ``batch_id`` partition. Replacing
that partition makes a retried batch leave no second copy, so a restart from
the checkpoint after a lost driver adds nothing twice. One checkpoint belongs
to one target.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from lakeward.operators import layout, quality
from lakeward.plans.load_and_model import Ingestion
from lakeward.sources import files


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    kind: str = "parquet",
    max_files: int = 100,
    **options: str,
) -> DataFrame:
    """Stream over the files of a folder, at most ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)


def csv_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    na_values: Sequence[str] = files.NA_VALUES,
    max_files: int = 100,
    **options: str,
) -> DataFrame:
    """Stream over CSV files, read like ``files.read_csv`` reads one.

    The same missing-value tokens become nulls, and a value that has not its
    column's type fails the batch, which is then read again as a whole.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    settings = {"header": "true", "quote": '"', "escape": '"', **options}
    text = file_stream(spark, path, texts, "csv", max_files, **settings)
    return files.cast_to(files.without_tokens(text, na_values), schema)


def ingest(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    tenant_id: str,
    source_type: str,
    as_of: dt.datetime | None = None,
    limits: quality.Limits | None = quality.Limits(),
    before_write: Callable[[DataFrame, int], None] | None = None,
) -> Ingestion:
    """Process every file that is there, then stop; reports the batches of this run.

    Each batch is checked like a batch load: issues are reported and do not
    stop it. ``before_write`` may look at a batch, and fail it.
    """
    done = Ingestion(target=target)

    def write(batch: DataFrame, batch_id: int) -> None:
        if before_write is not None:
            before_write(batch, batch_id)
        # Checked and written from one read; the batch size is bounded by the
        # files per trigger, and a lost block is read again.
        held = batch.persist(StorageLevel.MEMORY_AND_DISK) if limits is not None else batch
        try:
            if limits is not None:
                report = quality.validate(held, limits)
                done.issues += [f"batch {batch_id}: {message}" for message in report.messages]
                done.bytes += report.bytes
            seen = Observation()
            stamped = layout.stamp(held, tenant_id, source_type, as_of)
            watched = stamped.observe(seen, F.count(F.lit(1)).alias("rows"))
            watched.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            done.records += seen.get["rows"]
            done.batches += 1
        except Exception:
            done.errors += 1
            raise
        finally:
            if limits is not None:
                held.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return done


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows written so far, with the batch they came in."""
    return spark.read.parquet(target)


def batches(spark: SparkSession, target: str) -> DataFrame:
    """Rows per batch."""
    return ingested(spark, target).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
