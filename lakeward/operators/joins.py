"""Joins between row-level tables and the small tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakeward.operators.ranking import join_null_safe
from lakeward.session import stage


def join_summary(fact: DataFrame, summary: DataFrame, on: Column | str | list[str], how: str = "left") -> DataFrame:
    """Join rows to a per-key summary.

    The summary is staged, so the optimizer knows its real size: it is
    broadcast below ``autoBroadcastJoinThreshold`` and shuffled beyond, where
    adaptive execution splits the partitions of a hot key.
    """
    return fact.join(stage(summary, "summary"), on, how)


def with_group_totals(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``agg(...) over (partition by keys)`` as a pre-aggregated join.

    A window would gather each key in one task; a grouped aggregate combines
    before the shuffle and its result is joined back.
    """
    totals = stage(df.groupBy(*keys).agg(*aggregates), "totals")
    return join_null_safe(df, totals, list(keys), "left")


def lookup(
    rows: DataFrame, index: DataFrame, rows_key: Column, index_key: str
) -> tuple[DataFrame, DataFrame]:
    """Rows with what the index says about them, and the keys it does not know."""
    index = stage(index.withColumnRenamed(index_key, "_index_key"), "index")
    keyed = rows.withColumn("lookup_key", rows_key)
    same = F.col("lookup_key") == F.col("_index_key")
    found = keyed.join(index, same, "inner").drop("_index_key")
    missing = (
        keyed.join(index.select("_index_key"), same, "left_anti")
        .groupBy("lookup_key")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return found, missing
