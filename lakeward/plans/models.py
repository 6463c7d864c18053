"""Staging views and marts over patient records, as DataFrame functions.

Input column names are snake case (``blood_pressure``); ``with_plain_names``
takes the spaced originals there. Time is an argument, never the clock, so a
rerun gives the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lakeward.functions import columns as c
from lakeward.operators.joins import join_summary
from lakeward.operators.ranking import add_ranks, number_rows

SYMPTOMS = ["fever", "cough", "fatigue", "difficulty_breathing"]
REQUIRED = ["disease", "age", "gender", "outcome_variable"]


def with_plain_names(df: DataFrame) -> DataFrame:
    """``"Blood Pressure"`` becomes ``blood_pressure``."""
    return df.withColumnsRenamed({n: n.strip().lower().replace(" ", "_") for n in df.columns})


def stg_rev(rev: DataFrame) -> DataFrame:
    """Exact-match flags per record."""
    return rev.select(
        "disease",
        c.flag_exact("fever").alias("fever_flag"),
        c.flag_exact("cough").alias("cough_flag"),
        c.flag_exact("fatigue").alias("fatigue_flag"),
        c.flag_exact("difficulty_breathing").alias("breath_flag"),
        "age",
        "gender",
        "blood_pressure",
        "cholesterol_level",
        c.tristate("outcome_variable", "Positive", "Negative").alias("outcome_binary"),
    )


def _clean_columns(as_of: dt.datetime | None, source_system: str) -> list[Column]:
    flags = {f"has_{name}": c.flag(name) for name in SYMPTOMS}
    age = F.col("age").cast("int")
    outcome = c.normalize("outcome_variable")
    return [
        c.normalize("disease").alias("disease_name"),
        *[column.alias(name) for name, column in flags.items()],
        age.alias("age"),
        c.normalize("gender").alias("gender"),
        c.normalize("blood_pressure").alias("blood_pressure_level"),
        c.normalize("cholesterol_level").alias("cholesterol_level"),
        c.tristate(outcome, "POSITIVE", "NEGATIVE").alias("outcome_binary"),
        outcome.alias("outcome_label"),
        c.total(list(flags.values())).alias("total_symptoms"),
        c.age_group(age).alias("age_group"),
        c.moment(as_of).alias("processed_at"),
        F.lit(source_system).alias("source_system"),
    ]


def clean_health(
    rev: DataFrame, as_of: dt.datetime | None = None, source_system: str = "duckdb"
) -> DataFrame:
    """Normalized, typed and banded records; rows without a required value are dropped.

    Everything of the staging view but the surrogate key, which alone needs a
    sort. Marts that do not use the key build on this.
    """
    return rev.filter(c.present(REQUIRED)).select(*_clean_columns(as_of, source_system))


def stg_health(
    rev: DataFrame,
    tie_break: str,
    as_of: dt.datetime | None = None,
    source_system: str = "duckdb",
) -> DataFrame:
    """The staging view with ``patient_id`` numbered by disease, age and gender.

    ``tie_break`` is a unique column of the input that settles equal keys and
    spreads a hot disease over many ranges of the sort.
    """
    order = [F.col(name).asc_nulls_last() for name in ["disease", "age", "gender", tie_break]]
    needed = [*REQUIRED, *SYMPTOMS, "blood_pressure", "cholesterol_level"]
    kept = rev.filter(c.present(REQUIRED)).select(*dict.fromkeys([*needed, tie_break]))
    numbered = number_rows(kept, order, "patient_id", needed)
    return numbered.select("patient_id", *_clean_columns(as_of, source_system))


def mart_rev_metrics(staged: DataFrame) -> DataFrame:
    """Counts and averages by gender."""
    return staged.groupBy("gender").agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.avg("outcome_binary").alias("positive_rate"),
        F.avg("fever_flag").alias("avg_fever"),
        F.avg("cough_flag").alias("avg_cough"),
        F.avg("breath_flag").alias("avg_breath_diff"),
        F.avg("age").alias("avg_age"),
    )


def mart_rev_summary(staged: DataFrame) -> DataFrame:
    """Cases, positivity and age by disease, blood pressure and cholesterol."""
    return staged.groupBy("disease", "blood_pressure", "cholesterol_level").agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.avg("outcome_binary").alias("positivity_rate"),
        F.avg("age").alias("avg_age"),
    )


def disease_metrics(health: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Measures per disease: volume, symptoms, demographics, risk."""

    def prevalence(name: str) -> Column:
        return F.round(F.avg(F.col(name).cast("double")) * 100, 2)

    positive = c.share_of_rows(F.col("outcome_binary") == 1)
    return health.groupBy("disease_name").agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("outcome_binary") == 1).alias("positive_cases"),
        F.count_if(F.col("outcome_binary") == 0).alias("negative_cases"),
        positive.alias("positivity_rate"),
        prevalence("has_fever").alias("fever_prevalence"),
        prevalence("has_cough").alias("cough_prevalence"),
        prevalence("has_fatigue").alias("fatigue_prevalence"),
        prevalence("has_difficulty_breathing").alias("breathing_difficulty_prevalence"),
        F.round(F.avg(F.col("total_symptoms").cast("double")), 2).alias("avg_symptoms_per_case"),
        F.round(F.avg(F.col("age").cast("double")), 1).alias("avg_age"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        c.share_of_rows(F.col("gender") == "FEMALE").alias("female_percentage"),
        c.share_of_rows(F.col("age_group") == "Child").alias("child_percentage"),
        c.share_of_rows(F.col("age_group") == "Adult").alias("adult_percentage"),
        c.share_of_rows(F.col("age_group") == "Senior").alias("senior_percentage"),
        c.share_of_rows(F.col("blood_pressure_level") == "HIGH").alias("high_bp_percentage"),
        c.share_of_rows(F.col("cholesterol_level") == "HIGH").alias("high_cholesterol_percentage"),
        c.risk_band(positive).alias("risk_category"),
        c.moment(as_of).alias("calculated_at"),
    )


def mart_disease_analytics(health: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Disease measures with three independent ranks, largest disease first."""

    def by(measure: str) -> list[tuple[str, bool]]:
        return [(measure, True), ("disease_name", False)]

    ranked = add_ranks(
        disease_metrics(health, as_of),
        {
            "case_volume_rank": by("total_cases"),
            "positivity_rank": by("positivity_rate"),
            "symptom_severity_rank": by("avg_symptoms_per_case"),
        },
    )
    return ranked.orderBy(F.col("total_cases").desc_nulls_last(), F.col("disease_name").asc_nulls_last())


def recent(df: DataFrame, column: str, days: int, as_of: dt.datetime) -> DataFrame:
    """Rows of the last ``days`` days before the day of ``as_of``."""
    midnight = dt.datetime.combine(as_of.date(), dt.time())
    since = midnight - dt.timedelta(days=days)
    return df.filter(F.col(column) >= c.timestamp_literal(since, df.schema[column].dataType))


def mart_integration(
    patients: DataFrame, mart: DataFrame, as_of: dt.datetime, days: int = 30
) -> DataFrame:
    """Recent patients with the figures of their disease (null for unknown ones)."""
    figures = mart.select(
        "disease_name",
        "total_cases",
        "positivity_rate",
        "avg_symptoms_per_case",
        F.col("calculated_at").alias("analytics_updated_at"),
    )
    window = recent(patients, "recorded_at", days, as_of)
    matched = F.upper("disease") == F.col("disease_name")
    return join_summary(window, figures, matched).drop("disease_name")


def mart_integration_local(health: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """The same shape from staged records only; the mart figures are null."""
    symptoms = {
        "fever": F.col("has_fever"),
        "cough": F.col("has_cough"),
        "fatigue": F.col("has_fatigue"),
        "breathing_difficulty": F.col("has_difficulty_breathing"),
    }
    person = {name: F.col(name) for name in ["age", "gender", "age_group"]}
    return recent(health, "processed_at", days, as_of).select(
        "patient_id",
        F.col("disease_name").alias("disease"),
        c.json_object(symptoms).alias("symptoms"),
        c.json_object(person).alias("demographics"),
        F.col("outcome_label").alias("outcome"),
        F.col("processed_at").alias("recorded_at"),
        F.lit(None).cast("bigint").alias("total_cases"),
        F.lit(None).cast("double").alias("positivity_rate"),
        F.lit(None).cast("double").alias("avg_symptoms_per_case"),
        F.lit(None).cast("timestamp_ntz").alias("analytics_updated_at"),
    )


def patient_daily(patients: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Cases, positivity and mean age by disease and day over the last days."""
    window = recent(patients, "recorded_at", days, as_of)
    positive = F.when(F.col("outcome") == "Positive", 1.0).otherwise(0.0)
    return window.groupBy(
        "disease", c.trunc_to("day", "recorded_at", window).alias("recorded_date")
    ).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.avg(positive).alias("positivity_rate"),
        F.avg(c.json_value("demographics", "age", "int")).alias("avg_age"),
    )
