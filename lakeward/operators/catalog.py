"""Catalog listings, statistics and the tenant and dataset registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeward.operators import maintenance
from lakeward.operators.ranking import number_within
from lakeward.operators.sinks import append_or_create
from lakeward.sources.files import schema_report
from lakeward.sources.tables import quoted


def list_catalogs(spark: SparkSession) -> list[str]:
    return sorted(row.name for row in spark.catalog.listCatalogs())


def list_namespaces(spark: SparkSession) -> list[str]:
    return sorted(row.name for row in spark.catalog.listDatabases())


def list_tables(spark: SparkSession, stores: Mapping[str, str]) -> list[str]:
    """Tables of several stores as ``store.table``; a store is a prefix and a namespace."""
    found = []
    for prefix, namespace in stores.items():
        for table in spark.catalog.listTables(namespace):
            if not table.isTemporary:
                found.append(f"{prefix}.{table.name}")
    return sorted(found)


def describe(spark: SparkSession, table: str) -> DataFrame:
    """Column names and types of a table."""
    columns = spark.table(table).schema.fields
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(columns)]
    return spark.createDataFrame(rows, "position bigint, column_name string, data_type string")


def statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """Null share, distinct count, low and high per column, and the row count.

    One pass over the table. Distinct counts are estimates unless ``exact``;
    exact ones are counted per column, each in an aggregate over that column
    alone, rather than by copying every row once per column. Low and high are given for
    numbers and times, as text. The line without a column name carries the
    row count.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    ordered = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        column = F.col(quoted(f.name))
        measures.append(F.count(column).alias(f"filled{i}"))
        if not exact:
            measures.append(distinct(column).alias(f"distinct{i}"))
        if isinstance(f.dataType, ordered):
            measures += [F.min(column).alias(f"low{i}"), F.max(column).alias(f"high{i}")]

    def line(name: Column, nulls: Column, values: Column, low: Column, high: Column, rows: Column) -> Column:
        return F.struct(
            name.cast("string").alias("column_name"),
            nulls.cast("double").alias("null_share"),
            values.cast("bigint").alias("distinct_values"),
            low.cast("string").alias("low_value"),
            high.cast("string").alias("high_value"),
            rows.cast("bigint").alias("row_count"),
        )

    none, lines = F.lit(None), []
    for i, f in enumerate(df.schema.fields):
        has_order = isinstance(f.dataType, ordered)
        nulls = F.try_divide(F.col("rows") - F.col(f"filled{i}"), F.col("rows").cast("double"))
        lines.append(
            line(
                F.lit(f.name),
                nulls,
                F.col(f"distinct{i}"),
                F.col(f"low{i}") if has_order else none,
                F.col(f"high{i}") if has_order else none,
                none,
            )
        )
    lines.append(line(none, none, none, none, none, F.col("rows")))
    figures = df.agg(*measures)
    if exact:
        counted = [df.agg(distinct(F.col(quoted(f.name))).alias(f"distinct{i}")) for i, f in enumerate(df.schema.fields)]
        # One row each; stacked and folded, so that no join is needed.
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counted, figures)
        figures = stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
    return figures.select(F.inline(F.array(*lines)))


def analyze(spark: SparkSession, table: str) -> None:
    """Store row and column statistics for the optimizer's join order and sizes."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def partitions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, files and bytes per partition of a file-based table.

    Rows are first counted per file, so a hot partition is combined from its
    files and not from its rows.
    """
    files = df.groupBy(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_size").alias("_size"),
    ).agg(F.count(F.lit(1)).alias("_rows"))
    return files.groupBy(*columns).agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("files"),
        F.sum("_size").alias("bytes"),
    )


def table_info(spark: SparkSession, table: str) -> dict[str, DataFrame | None]:
    """Description, statistics, history and partitions; None where there are none."""
    info: dict[str, DataFrame | None] = {
        "description": describe(spark, table),
        "stats": statistics(spark.table(table)),
    }
    has_history = spark.catalog.tableExists(f"{table}{maintenance.SNAPSHOT_SUFFIX}")
    info["history"] = maintenance.history(spark, table) if has_history else None
    columns = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    info["partitions"] = partitions(spark.table(table), columns) if columns else None
    return info


def register_dataset(
    spark: SparkSession,
    registry: str,
    tenant_id: str,
    name: str,
    target: str,
    rows: int,
    columns: int,
    at: dt.datetime,
) -> None:
    """Append one line to the dataset registry."""
    line = spark.createDataFrame(
        [(tenant_id, name, target, rows, columns, at)],
        "tenant_id string, name string, target string, rows bigint, columns int, upload_time timestamp_ntz",
    )
    append_or_create(line, registry)


def upsert_settings(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Tenant settings after a batch of updates, one row per tenant and key.

    A later update wins over an earlier one and over the current value; the
    update id settles equal times. ``created_at`` is the time of the first
    update of a key, ``updated_at`` of its last. Everything is combined before
    the shuffle, so a tenant that sends a third of all updates is no hot spot.
    """
    columns = ["tenant_id", "config_key", "config_value", "updated_at", "update_id"]
    rows = updates.select(*columns, F.col("updated_at").alias("created_at"))
    if current is not None:
        rows = current.select(*columns, "created_at").unionByName(rows)
    recency = F.struct("updated_at", "update_id")
    return rows.groupBy("tenant_id", "config_key").agg(
        F.max_by("config_value", recency).alias("config_value"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("update_id", recency).alias("update_id"),
        F.min("created_at").alias("created_at"),
    )


def tenant_table(settings: DataFrame, page_size: int = 1000) -> DataFrame:
    """Tenants with their settings as maps of ``page_size`` keys, in numbered pages.

    The keys of a tenant are numbered in order and every page but the last is
    full, so a tenant with very many keys is many rows and never one huge cell.
    """
    order = [F.col("config_key").asc_nulls_last()]
    numbered = number_within(settings, ["tenant_id"], order, "_n")
    entry = F.struct("config_key", "config_value")
    return numbered.groupBy("tenant_id", F.expr(f"(_n - 1) div {page_size}").alias("page")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("config"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def tenant_overview(settings: DataFrame, datasets: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """Per tenant: settings, datasets, catalogs it owns, statements and rows billed, in one result.

    The parts are counts; the lists are ``tenant_table``, the registry,
    ``catalog_index`` and the log themselves.
    """
    parts = {
        "settings": settings.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("settings")),
        "datasets": datasets.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("datasets")),
        "catalogs": catalog_index(links).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("catalogs")),
        "statements": log.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("statements")),
    }
    joined = reduce(lambda a, b: a.join(b, "tenant_id", "full"), parts.values())
    return joined.select("tenant_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in parts])


def catalog_index(links: DataFrame) -> DataFrame:
    """Owner of every catalog: the tenant of its latest link."""
    recency = F.struct("linked_at", "link_id")
    return links.groupBy("catalog_name").agg(
        F.max_by("tenant_id", recency).alias("tenant_id"), F.max("linked_at").alias("linked_at")
    )


def dataset_overview(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column counts of several datasets in one result."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


__all__ = [
    "analyze", "catalog_index", "dataset_overview", "describe", "list_catalogs", "list_namespaces", "list_tables", "partitions",
    "register_dataset", "schema_report", "statistics", "table_info", "tenant_overview", "tenant_table", "upsert_settings",
]
