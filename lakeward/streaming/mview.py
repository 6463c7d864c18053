"""Incrementally maintained daily patient figures.

Averages cannot be merged, so each micro-batch stores sums and counts per
disease and day in its own partition; a read adds the partitions up and
divides. A retried batch replaces its partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeward.functions import columns as c
from lakeward.session import delete_path, stage


def partial_figures(patients: DataFrame) -> DataFrame:
    """Mergeable sums and counts per disease and day."""
    age = c.json_value("demographics", "age", "int")
    return patients.groupBy(
        "disease", c.trunc_to("day", "recorded_at", patients).alias("recorded_date")
    ).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("outcome") == "Positive").alias("positive_cases"),
        F.sum(age).alias("age_sum"),
        F.count(age).alias("age_count"),
    )


def refresh(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Add the figures of all waiting files, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch's figures are few rows: as few files.
        figures = partial_figures(batch).hint("rebalance")
        figures.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


FIGURES = ["total_cases", "positive_cases", "age_sum", "age_count"]


def fold(spark: SparkSession, target: str) -> int:
    """Add up the figures of all batches into the newest one's folder; returns how many were folded.

    Run it while no refresh runs. The sum is written beside the folders first
    and takes the newest batch's place last, so a retry of that batch is the
    only one that must not come after it: fold after the checkpoint has moved on.
    """
    batches = sorted(
        r.batch_id for r in spark.read.parquet(target).select("batch_id").distinct().collect()
    )
    if len(batches) < 2:
        return 0
    summed = stage(_added(spark.read.parquet(target)), "folded")
    summed.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch_id={batches[-1]}")
    for batch in batches[:-1]:
        delete_path(spark, f"{target}/batch_id={batch}")
    return len(batches)


def _added(figures: DataFrame) -> DataFrame:
    return figures.groupBy("disease", "recorded_date").agg(*[F.sum(n).alias(n) for n in FIGURES])


def current(spark: SparkSession, target: str, as_of: dt.datetime | None = None, days: int = 30) -> DataFrame:
    """The view's rows: partial figures added up, rates derived.

    With ``as_of`` only the days from ``days`` before it on; a view keeps all
    days, and what is recent is decided when it is read.
    """
    figures = spark.read.parquet(target)
    if as_of is not None:
        figures = figures.where(F.col("recorded_date") >= F.lit(as_of - dt.timedelta(days=days)).cast(figures.schema["recorded_date"].dataType))
    return _added(figures).select(
        "disease",
        "recorded_date",
        "total_cases",
        F.try_divide(F.col("positive_cases").cast("double"), F.col("total_cases")).alias("positivity_rate"),
        F.try_divide(F.col("age_sum").cast("double"), F.col("age_count")).alias("avg_age"),
    )
