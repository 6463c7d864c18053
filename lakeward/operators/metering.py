"""Billing, counters and response times over the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeward.operators.ranking import top_rows
from lakeward.session import stage

# One unit per thousand rows, at least one; the usual response
# window; the length of the short form of a statement; the counters that are kept.
ROWS_PER_UNIT = 1000
RESPONSE_WINDOW = 1000
SHORT_TEXT = 200
_ABOUT = r"(?i)\b(?:from|into|update|table)\s+([a-z_][a-z0-9_.]*)"
COUNTERS = [
    "requests_total", "requests_failed", "active_connections",
    "data_volume_processed", "tables_created", "tables_updated",
]


def billed_units(rows: Column) -> Column:
    units = F.floor(F.coalesce(rows, F.lit(0)) / ROWS_PER_UNIT).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), units)


def billing_events(log: DataFrame) -> DataFrame:
    """One row per billable statement: tenant, time, amount, engine."""
    return log.filter("bill").select(
        "tenant_id",
        F.col("created").alias("ts"),
        billed_units(F.col("row_count")).alias("amount"),
        F.coalesce("engine", F.lit("query")).alias("type"),
    )


def billing(log: DataFrame) -> DataFrame:
    """Number and total of the billing events per tenant.

    The events themselves are rows of ``billing_events``; a list per tenant
    would gather a busy tenant in one cell.
    """
    return billing_events(log).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_bill_events"), F.sum("amount").alias("total_amount")
    )


def metric_events(log: DataFrame) -> DataFrame:
    """The counter increments every logged statement stands for."""
    kind = F.upper(F.ltrim("query"))
    increments = {
        "requests_total": F.lit(1),
        "requests_failed": (F.col("state") == "FAILED").cast("int"),
        "data_volume_processed": F.col("row_count"),
        "tables_created": kind.startswith("CREATE").cast("int"),
        "tables_updated": (kind.startswith("INSERT") | kind.startswith("UPDATE")).cast("int"),
    }
    lines = [
        F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value"))
        for name, value in increments.items()
    ]
    return log.select(F.inline(F.array(*lines)))


def counters(events: DataFrame) -> DataFrame:
    """Sum per known metric; what ``unknown_metrics`` finds is not in it."""
    known = events.filter(F.col("metric").isin(COUNTERS))
    return known.groupBy("metric").agg(F.sum("value").alias("value"))


def unknown_metrics(events: DataFrame) -> DataFrame:
    """Increments that no counter takes, counted per metric: a warning, not a sum."""
    unknown = events.filter(~F.coalesce(F.col("metric").isin(COUNTERS), F.lit(False)))
    return unknown.groupBy("metric").agg(F.count(F.lit(1)).alias("increments"))


def response_times(
    log: DataFrame, moment: str, latency: str, tie_break: str, window: int = RESPONSE_WINDOW
) -> DataFrame:
    """Mean, longest and shortest of the latest ``window`` measurements."""
    newest = [F.col(moment).desc_nulls_last(), F.col(tie_break).desc_nulls_last()]
    latest = top_rows(log.select(moment, tie_break, latency), newest, window)
    return latest.agg(
        F.avg(latency).alias("avg_response_time"),
        F.max(latency).alias("max_response_time"),
        F.min(latency).alias("min_response_time"),
        F.count(latency).alias("measurements"),
    )


def log_entries(log: DataFrame, tenants: DataFrame | None = None, table: str | None = None) -> DataFrame:
    """Query-log lines as they are stored: the whole text and its short form, latency 0 by default.

    ``table`` names the column with the table that a statement is about; without
    one the first name after FROM, INTO, UPDATE or TABLE is taken. With a tenant
    table, statements of unknown tenants are not logged.
    """
    if tenants is not None:
        known = stage(tenants.select("tenant_id").distinct(), "tenants")
        log = log.join(known, "tenant_id", "left_semi")
    about = F.col(table) if table else F.nullif(F.regexp_extract("query", _ABOUT, 1), F.lit(""))
    return log.select(
        "query_id",
        "tenant_id",
        "query",
        F.substring("query", 1, SHORT_TEXT).alias("short_query"),
        "engine",
        about.alias("table"),
        F.col("row_count").alias("rows"),
        F.coalesce("latency_us", F.lit(0)).alias("latency_us"),
        F.col("created").alias("ts"),
    )
