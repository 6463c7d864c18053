"""Writing frames to tables and files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeward.operators import layout, maintenance

# Kinds of target.
LOCAL, LAKE = "local", "lake"


def append_or_create(df: DataFrame, table: str, by_name: bool = False) -> None:
    """Create the table from the frame, or add its rows to it.

    The first write fixes the schema; later ones are positional unless
    ``by_name``.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.saveAsTable(table)
    elif by_name:
        columns = spark.table(table).columns
        if {c.lower() for c in columns} != {c.lower() for c in df.columns}:
            raise ValueError(f"{table} has the columns {columns}, the rows have {df.columns}")
        df.select(*[f"`{c}`" for c in columns]).write.insertInto(table)
    else:
        df.write.insertInto(table)


def overwrite(df: DataFrame, table: str) -> None:
    """Replace a table and its schema; running queries keep the old files. The frame may read the table."""
    maintenance.publish(df, table)


def lake_append(df: DataFrame, table: str) -> None:
    """Append with lake types: what has no lake type is stored as text."""
    append_or_create(layout.coerce_types(df), table)


def create_table(df: DataFrame, table: str, target: str) -> None:
    """Create a table; an existing local one is inserted into, an existing lake one is an error."""
    if target == LAKE:
        layout.coerce_types(df).write.mode("errorifexists").saveAsTable(table)
    elif target == LOCAL:
        append_or_create(df, table)
    else:
        raise ValueError(f"unknown target {target!r}: use {LOCAL!r} or {LAKE!r}")


def insert(df: DataFrame, table: str, target: str, mode: str = "append") -> None:
    """Insert by position into an existing table."""
    if target not in (LOCAL, LAKE):
        raise ValueError(f"unknown target {target!r}: use {LOCAL!r} or {LAKE!r}")
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = layout.coerce_types(df) if target == LAKE else df
    if mode == "append":
        rows.write.insertInto(table)
        return
    fields = df.sparkSession.table(table).schema.fields
    if len(fields) != len(rows.columns):
        raise ValueError(f"{table} has {len(fields)} columns, the rows have {len(rows.columns)}")
    placed = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, fields)]
    maintenance.publish(rows.select(placed), table)


def create_table_as(
    spark: SparkSession, table: str, query: str, properties: Mapping[str, str] | None = None
) -> str | None:
    """Create a table from a query; the reason when that fails, else None."""
    try:
        writer = spark.sql(query).writeTo(table).using("parquet")
        for key, value in (properties or {}).items():
            writer = writer.tableProperty(key, value)
        writer.create()
    except PySparkException as error:
        return _reason(error)
    return None


def insert_select(spark: SparkSession, table: str, query: str) -> str | None:
    """Insert the rows of a query by position; the reason when that fails, else None."""
    try:
        spark.sql(query).write.insertInto(table)
    except PySparkException as error:
        return _reason(error)
    return None


def _reason(error: PySparkException) -> str:
    return next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)


def grouped_by(df: DataFrame, column: str = "tenant_id") -> DataFrame:
    """Rows of a tenant brought together for the write, where the column exists.

    ``rebalance`` lets adaptive execution split a hot tenant over several
    tasks and merge small ones.
    """
    return df.hint("rebalance", column) if column in df.columns else df


def write_files(df: DataFrame, path: str, column: str = "tenant_id", mode: str = "append") -> None:
    """Snappy Parquet, one folder per tenant where the column exists."""
    writer = df.write.partitionBy(column) if column in df.columns else df.write
    writer.mode(mode).option("compression", "snappy").parquet(path)


def write_partitioned(df: DataFrame, path: str, column: str = "tenant_id", mode: str = "append") -> None:
    """Bring each tenant's rows together and write them as its folder."""
    write_files(grouped_by(df, column), path, column, mode)


def write_arranged(df: DataFrame, path: str, mode: str = "append") -> layout.Strategy:
    """Write a stamped load with the layout its columns ask for."""
    plan = layout.strategy(df)
    arranged = layout.arrange(df, plan)
    arranged.write.mode(mode).partitionBy(*plan.partition_by).option(
        "compression", "snappy"
    ).parquet(path)
    return plan


def write_bucketed(
    df: DataFrame,
    table: str,
    key: str,
    sort_by: str,
    buckets: int = 16,
    file_bytes: int = maintenance.TARGET_FILE_BYTES,
) -> None:
    """Table bucketed by a key and sorted inside each file, in files of about ``file_bytes``.

    The bytes of each bucket are measured first (one aggregate, one row per
    bucket; the frame is computed once for it and once for the write), and a
    bucket gets as many files as they ask for. Its rows are dealt over these by
    a hash of the whole row, so a key that holds half of all rows is written by
    many tasks, while every task still writes one bucket.
    """
    spark = df.sparkSession
    bucket = F.expr(f"pmod(hash(`{key}`), {buckets})")  # Spark's own bucket number
    measured = df.groupBy(bucket.alias("_b")).agg(F.sum(layout.row_bytes(df)).alias("_bytes")).collect()
    sizes = {r["_b"]: r["_bytes"] or 0 for r in measured}
    # A row per bucket: the number of its first file, and how many it has. Every bucket
    # has one, so rows that the measurement did not see are written too.
    places, total = [], 0
    for b in range(buckets):
        files = max(1, -(-sizes.get(b, 0) // file_bytes))
        places.append((b, total, files))
        total += files
    numbered = df.withColumn("_b", bucket).join(F.broadcast(spark.createDataFrame(places, "_b int, _start long, _files long")), "_b")
    file = F.col("_start") + F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.col("_files"))
    dealt = numbered.withColumn("_file", file).repartitionById(total, F.col("_file").cast("int")).select(*[f"`{c}`" for c in df.columns])
    dealt.write.bucketBy(buckets, key).sortBy(sort_by).saveAsTable(table)


def write_monthly(df: DataFrame, table: str, date: str, region: str) -> None:
    """Table partitioned by the month of a date and by region."""
    month = F.date_trunc("month", date).cast("date")
    dated = df.withColumn("month", month).hint("rebalance", "month", region)
    dated.write.partitionBy("month", region).saveAsTable(table)


def arrow_batches(df: DataFrame, limit: int | None = None, chunk_size: int = 10_000) -> DataFrame:
    """The rows as Arrow IPC payloads of at most ``chunk_size`` rows.

    Batches are cut and serialized in the tasks; a client streams them with
    ``toLocalIterator`` or writes them out, and never needs the whole result.
    """
    if limit is not None:
        df = df.limit(limit)

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_size):
                part = batch.slice(start, chunk_size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_pydict(
                    {"rows": [part.num_rows], "payload": [sink.getvalue().to_pybytes()]},
                    schema=pa.schema([("rows", pa.int64()), ("payload", pa.binary())]),
                )

    return df.mapInArrow(serialize, "rows bigint, payload binary")


def from_arrow_batches(batches: DataFrame, schema) -> DataFrame:
    """Rows of serialized batches, decoded in the tasks."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for payload in part.column("payload"):
                with pa.ipc.open_stream(payload.as_buffer()) as reader:
                    yield from reader

    return batches.select("payload").mapInArrow(decode, schema)


def month_filter(date: str, low, high):
    """Filter on a date range that also prunes the month partitions."""
    inside = F.col(date).between(F.lit(low), F.lit(high))
    months = F.col("month").between(
        F.date_trunc("month", F.lit(low)).cast("date"), F.lit(high)
    )
    return inside & months

