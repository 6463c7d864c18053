"""SQL text run as it is, over views of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.functions import sql
from lakeward.plans.fixtures import Tables, oracle


def _statement(t: Tables, text: str, **args) -> DataFrame:
    sql.register_functions(t.spark)
    t.register()
    return sql.run_sql(t.spark, text, args)


@case(
    "sql_json_average",
    oracle(
        """select disease, avg(cast(demographics ->> '$.age' as int)) as avg_age from patient_data group by disease""",
        "patient_data",
    ),
)
def json_average(t: Tables) -> DataFrame:
    return _statement(
        t,
        """SELECT disease, AVG(CAST(JSON_EXTRACT_SCALAR(demographics, '$.age') AS INTEGER)) AS avg_age
           FROM patient_data GROUP BY disease""",
    )


@case(
    "sql_quoted_names",
    oracle(
        """select gender as "Gender", blood_pressure as "Blood Pressure", count(*) as total_patients, max(age) as oldest
from rev group by gender, blood_pressure""",
        "rev",
    ),
)
def quoted_names(t: Tables) -> DataFrame:
    spaced = t.rev.select(
        F.col("gender").alias("Gender"), F.col("blood_pressure").alias("Blood Pressure"), F.col("age").alias("Age")
    )
    spaced.createOrReplaceTempView("spaced_records")
    return _statement(
        t,
        """SELECT "Gender", "Blood Pressure", COUNT(*) AS total_patients, MAX(age) AS oldest
           FROM spaced_records GROUP BY "Gender", "Blood Pressure" """,
    )


@case(
    "sql_parameters",
    oracle(
        """select disease, count(*) as n from patient_data where outcome = 'Positive'
and recorded_at >= cast(date '2024-01-20' as timestamp) - interval '7' day group by disease""",
        "patient_data",
    ),
)
def parameters(t: Tables) -> DataFrame:
    return _statement(
        t,
        """SELECT disease, COUNT(*) AS n FROM patient_data
           WHERE outcome = :outcome AND recorded_at >= DATE'2024-01-20' - INTERVAL '7' DAY GROUP BY disease""",
        outcome="Positive",
    )
