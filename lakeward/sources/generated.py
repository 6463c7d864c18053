"""Rows made from a number, a seed or a literal list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeward.functions import columns as c
from lakeward.sources.tables import quoted

# Sample choices.
SERIES_DISEASES = ["Flu", "Cold", "Headache", "Allergy"]
SAMPLE_DISEASES = ["COVID-19", "Influenza", "Pneumonia", "Bronchitis", "Asthma"]
GENDERS = ["Male", "Female"]
OUTCOMES = ["Positive", "Negative"]
LOCATIONS = ["Urban", "Rural"]


def local_patients(numbers: DataFrame, number: str = "id") -> DataFrame:
    """Patients computed from their number 1..n."""
    n = F.col(number)
    return numbers.select(
        F.concat(F.lit("P"), n.cast("string")).alias("patient_id"),
        c.pick(SERIES_DISEASES, n).alias("disease"),
        (20 + n % 50).alias("age"),
        c.pick(GENDERS, n).alias("gender"),
        c.pick(OUTCOMES, n).alias("outcome"),
    )


def series(spark: SparkSession, n: int) -> DataFrame:
    """The numbers 1..n, split over tasks."""
    return spark.range(1, n + 1)


def sample_patients(
    numbers: DataFrame, seed: int, as_of: dt.datetime, number: str = "id"
) -> DataFrame:
    """Repeatable random patients with JSON symptoms and demographics."""
    n = F.col(number)

    def draw(what: str, below: int):
        return F.pmod(c.seeded_number(n, seed, what), F.lit(below))

    symptoms = {s: draw(s, 2) == 1 for s in ["fever", "cough", "fatigue", "breathing_difficulty"]}
    person = {
        "age": (18 + draw("age", 62)).cast("int"),
        "gender": c.pick(GENDERS, draw("gender", 2)),
        "location": c.pick(LOCATIONS, draw("location", 2)),
    }
    days = F.make_dt_interval(draw("day", 30).cast("int"))
    return numbers.select(
        F.concat(F.lit("P"), F.lpad(n.cast("string"), 12, "0")).alias("patient_id"),
        c.pick(SAMPLE_DISEASES, draw("disease", len(SAMPLE_DISEASES))).alias("disease"),
        c.json_object(symptoms).alias("symptoms"),
        c.json_object(person).alias("demographics"),
        c.pick(OUTCOMES, draw("outcome", 2)).alias("outcome"),
        (c.moment(as_of) - days).alias("recorded_at"),
    )


def insert_values(
    spark: SparkSession, table: str, rows: Sequence[tuple], schema: str, batch: int = 10
) -> int:
    """Insert literal rows in batches; returns the number of batches."""
    batches = 0
    for start in range(0, len(rows), batch):
        spark.createDataFrame(rows[start : start + batch], schema).write.insertInto(
            ".".join(quoted(part) for part in table.split("."))
        )
        batches += 1
    return batches
