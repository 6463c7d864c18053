"""Table scans, samples, seeds and views over catalog tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, types as T


def scan(
    spark: SparkSession,
    table: str,
    query: str | None = None,
    limit: int | None = None,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """A table, or the result of a query with bound parameters.

    As in the reference behaviour, the limit applies to a plain table scan
    only; a query carries its own.
    """
    if query is not None:
        return spark.sql(query, args=dict(args or {}))
    df = spark.table(table)
    return df if limit is None else df.limit(limit)


def sample(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """First rows in the given order, or any rows when no order is given."""
    return (df.orderBy(*order) if order else df).limit(count)


def seed(spark: SparkSession, path: str, schema: T.StructType | str, table: str) -> DataFrame:
    """Load a seed CSV with a declared schema into a table, replacing it."""
    df = spark.read.schema(schema).csv(path, header=True)
    df.write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def reflect_views(spark: SparkSession, namespace: str, prefix: str = "") -> list[str]:
    """One temporary view per table of a namespace; rerun after each write (``load_and_model.settle``)."""
    names = []
    for table in spark.catalog.listTables(namespace):
        if table.isTemporary:
            continue
        view = f"{prefix}{table.name}"
        spark.table(f"{quoted(namespace)}.{quoted(table.name)}").createOrReplaceTempView(quoted(view))
        names.append(view)
    return sorted(names)


def quoted(name: str) -> str:
    """Identifier in backticks, safe for names with dashes or spaces."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(spark: SparkSession, query: str) -> T.StructType:
    """Schema of a query; analysed, never run."""
    return spark.sql(query).schema
