"""Reading database tables through Spark's JDBC source, split over tasks."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Default ports.
PORTS = {"mysql": 3306, "postgresql": 5432, "sqlserver": 1433}


def jdbc_url(config: Mapping[str, Any]) -> str:
    """Connection URL of a ``type``/``host``/``port``/``database`` description."""
    kind = config["type"]
    database = config.get("database", "")
    if kind == "sqlite":
        return f"jdbc:sqlite:{database}"
    if kind not in PORTS:
        raise ValueError(f"unsupported database type: {kind}")
    server = f"//{config.get('host', 'localhost')}:{config.get('port') or PORTS[kind]}"
    if kind == "sqlserver":
        return f"jdbc:sqlserver:{server};databaseName={database}"
    return f"jdbc:{kind}:{server}/{database}"


def jdbc_options(
    config: Mapping[str, Any],
    query: str | None = None,
    table: str | None = None,
    chunk_size: int | None = None,
    split_on: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    splits: int | None = None,
) -> dict[str, str]:
    """Reader options; ``split_on`` with bounds turns one read into ``splits`` ranges.

    Bounds only place the borders: rows outside them fall into the first or
    last range, so a wrong guess costs balance, not rows.
    """
    if not query and not table:
        raise ValueError("either query or table is needed")
    options = {"url": jdbc_url(config)}
    for name in ("user", "password"):
        if config.get(name):
            options[name] = str(config[name])
    # A subquery, as the plain query option cannot be split.
    options["dbtable"] = f"({query}) source_query" if query else str(table)
    if chunk_size:
        options["fetchsize"] = str(chunk_size)
    if split_on:
        if not bounds or not splits:
            raise ValueError("splitting needs bounds and a number of splits")
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits),
        }
    return options


def read_jdbc(spark: SparkSession, config: Mapping[str, Any], **read: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config, **read)).load()


def jdbc_schema(spark: SparkSession, config: Mapping[str, Any], table: str) -> dict[str, str]:
    """Column types of a database table; no rows are read."""
    schema = read_jdbc(spark, config, table=table).schema
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def check_connection(spark: SparkSession, config: Mapping[str, Any]) -> tuple[bool, str]:
    """Whether ``select 1`` works, and the error otherwise."""
    try:
        read_jdbc(spark, config, query="select 1 as one").collect()
    except Exception as error:  # whatever the driver throws is the answer
        return False, str(error).splitlines()[0]
    return True, ""
