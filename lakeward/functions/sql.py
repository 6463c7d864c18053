"""SQL text written for other engines: missing functions and quoted names.

The functions are SQL functions, which Catalyst inlines; nothing leaves the
generated code.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Functions other engines have, as expressions Spark has.
FUNCTIONS = {
    "json_extract_scalar": ("document STRING, path STRING", "STRING", "get_json_object(document, path)"),
    "json_extract": ("document STRING, path STRING", "STRING", "get_json_object(document, path)"),
    "json_extract_string": ("document STRING, path STRING", "STRING", "get_json_object(document, path)"),
    "day_of_week": ("moment TIMESTAMP_NTZ", "BIGINT", "cast(dayofweek(moment) - 1 AS BIGINT)"),
}

_QUOTED_NAMES = "spark.sql.ansi.doubleQuotedIdentifiers"


def register_functions(spark: SparkSession) -> None:
    """Make the functions above known to the session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}"
        )


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """A statement with bound parameters in which ``"Blood Pressure"`` is a name.

    The setting only matters while the text is parsed, so it is restored
    before the result is used.
    """
    before = spark.conf.get(_QUOTED_NAMES)
    spark.conf.set(_QUOTED_NAMES, "true")
    try:
        return spark.sql(text, args=dict(args or {}))
    finally:
        spark.conf.set(_QUOTED_NAMES, before)
