"""Tenant stamping, type coercion and the layout a load is written in."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakeward.functions import columns as c

# Types a lake table keeps; anything else is stored as text.
LAKE_TYPES = {"string", "bigint", "int", "double", "float", "boolean", "timestamp", "timestamp_ntz"}

# Borders between small and large. They label a load; nothing is
# written differently for it.
LOAD_ROWS = 1_000_000
LOAD_BYTES = 500 * 1024 * 1024
UPLOAD_ROWS = 100_000


def stamp(
    df: DataFrame, tenant_id: str, source_type: str, as_of: dt.datetime | None = None
) -> DataFrame:
    """Add the tenant, the load time (UTC) and the kind of source."""
    return df.withColumns(
        {
            "tenant_id": F.lit(tenant_id),
            "ingestion_timestamp": c.moment(as_of),
            "source_type": F.lit(source_type),
        }
    )


def coerce_types(df: DataFrame) -> DataFrame:
    """Cast every column to a lake type; types without one become strings."""
    return df.select(
        *[
            F.col(f"`{f.name}`")
            if f.dataType.simpleString() in LAKE_TYPES
            else F.col(f"`{f.name}`").cast("string").alias(f.name)
            for f in df.schema.fields
        ]
    )


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: text by its UTF-8 length, other types by their width."""
    widths = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(column)))
        else:
            size = F.when(column.isNotNull(), _width(field.dataType))
        widths.append(F.coalesce(size, F.lit(0)).cast("bigint"))
    total = F.lit(0).cast("bigint")
    for width in widths:
        total = total + width
    return total


def _width(data_type: T.DataType) -> int:
    if isinstance(data_type, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(data_type, T.ShortType):
        return 2
    if isinstance(data_type, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(data_type, T.DecimalType):
        return 16
    return 8


def size_of(df: DataFrame) -> DataFrame:
    """Rows and bytes of a whole frame, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"),
    )


def load_target(rows: Column, size: Column) -> Column:
    """Where a load goes: ``large`` above either border, else ``small``."""
    return F.when((rows > LOAD_ROWS) | (size > LOAD_BYTES), "large").otherwise("small")


def route_target(rows: Column) -> Column:
    """Which engine a table of this many rows is queried on: ``large`` above the row border only."""
    return F.when(rows > LOAD_ROWS, "large").otherwise("small")


def upload_target(rows: Column) -> Column:
    return F.when(rows > UPLOAD_ROWS, "large").otherwise("small")


def size_class(rows: int, size: int) -> str:
    """``load_target`` for figures that are already known."""
    return "large" if rows > LOAD_ROWS or size > LOAD_BYTES else "small"


@dataclass(frozen=True)
class Strategy:
    """How a stamped load is laid out on disk."""

    partition_by: list[str]
    sort_by: list[str]
    day_of: str | None


def strategy(df: DataFrame, partitioning: bool = True) -> Strategy:
    """Partition by tenant and the day of the first timestamp, sort by load time."""
    moments = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    day_of = moments[0] if moments and partitioning else None
    return Strategy(
        partition_by=["tenant_id", *(["day"] if day_of else [])],
        sort_by=["ingestion_timestamp"],
        day_of=day_of,
    )


def arrange(df: DataFrame, plan: Strategy) -> DataFrame:
    """Rows grouped and sorted for the write.

    ``rebalance`` groups by the partition columns and lets adaptive execution
    split a hot tenant's share into several files and merge small ones.
    """
    if plan.day_of:
        df = df.withColumn("day", F.to_date(plan.day_of))
    grouped = df.hint("rebalance", *plan.partition_by)
    return grouped.sortWithinPartitions(*plan.partition_by, *plan.sort_by)
