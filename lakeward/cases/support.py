"""Scratch namespaces for queries that write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from lakeward.operators import maintenance
from lakeward.session import fresh_path, remember_namespace


def namespace(spark: SparkSession) -> str:
    """A new namespace whose tables lie in the shared folder."""
    name = f"scratch_{uuid.uuid4().hex[:10]}"
    maintenance.create_namespace(spark, name, fresh_path(spark, "namespace"))
    remember_namespace(name)
    return name
