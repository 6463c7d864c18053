"""From a source to tables and marts: ingestion and the model run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lakeward.operators import catalog, layout, maintenance, quality, sinks
from lakeward.plans import models as m
from lakeward.sources import files, jdbc
from lakeward.sources.tables import reflect_views


LOAD_ID = "load_id"


@dataclass
class Ingestion:
    """What an ingestion did; ``size_class`` is a label of the load and decides nothing."""

    records: int = 0
    batches: int = 0
    bytes: int = 0
    errors: int = 0
    seconds: float = 0.0
    target: str = ""
    size_class: str = ""
    issues: list[str] = field(default_factory=list)


def ingest(
    df: DataFrame,
    target: str,
    tenant_id: str,
    source_type: str,
    as_of: dt.datetime | None = None,
    limits: quality.Limits | None = quality.Limits(),
    kind: str = "table",
    load_id: str | None = None,
    settled: bool = False,
) -> Ingestion:
    """Check, stamp and append a source; issues only warn.

    ``target`` is a table, or a folder with ``kind="files"``; loads of any size
    go to it. With a ``load_id`` the load is a partition of its own that a
    repeated load replaces, so a retry adds nothing twice. A write that fails is
    counted in ``errors`` and reported as an issue. With ``settled`` views and a
    snapshot of the table's namespace follow the write. Row and byte figures are
    observed on the write itself.
    """
    if kind not in ("table", "files"):
        raise ValueError(f"unknown kind of target {kind!r}")
    started = dt.datetime.now(dt.timezone.utc)
    done = Ingestion(target=target)
    if limits is not None:
        done.issues += quality.validate(df, limits).messages
    seen = Observation()
    stamped = layout.stamp(df, tenant_id, source_type, as_of)
    if load_id is not None:
        stamped = stamped.withColumn(LOAD_ID, F.lit(load_id))
    # A load has one tenant, a constant: a rebalance by it would put the whole
    # load into one task. Without a key, small loads end in few files and large
    # ones are split over tasks of the advisory size.
    stamped = stamped.hint("rebalance")
    # Observed after the last shuffle: a map task that runs again after a lost
    # executor would be counted twice.
    watched = stamped.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(layout.row_bytes(stamped)).alias("bytes")
    )
    try:
        _store(watched, target, kind, load_id)
        done.records, done.bytes, done.batches = seen.get["rows"], seen.get["bytes"] or 0, 1
        done.size_class = layout.size_class(done.records, done.bytes)
        if settled and kind == "table":
            settle(df.sparkSession, target, as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    except (PySparkException, ValueError) as error:
        done.errors += 1
        done.issues.append(f"not written: {error}")
    done.seconds = (dt.datetime.now(dt.timezone.utc) - started).total_seconds()
    return done


def _store(rows: DataFrame, target: str, kind: str, load_id: str | None) -> None:
    spark = rows.sparkSession
    if kind == "files":
        columns = ["tenant_id"] if load_id is None else ["tenant_id", LOAD_ID]
        writer = rows.write.partitionBy(*columns).option("compression", "snappy")
        if load_id is None:
            writer.mode("append").parquet(target)
        else:  # only the partitions that the load has rows for are replaced
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    elif load_id is None:
        sinks.append_or_create(rows, target, by_name=True)
    elif not spark.catalog.tableExists(target):
        maintenance.publish(rows, target, partition_by=(LOAD_ID,))
    else:
        maintenance.replace_partition(rows, target, {LOAD_ID: load_id})


def settle(spark: SparkSession, table: str, at: dt.datetime) -> tuple[list[str], list[str]]:
    """After a write: one view per table of the table's namespace, and a snapshot of them all."""
    namespace = table.rpartition(".")[0]
    taken = maintenance.snapshot(spark, namespace, at)
    return reflect_views(spark, namespace), taken


def read_source(spark: SparkSession, config: Mapping[str, Any], **read: Any) -> DataFrame:
    """Frame of a described source: ``csv``, ``parquet`` or a database type."""
    kind = config["type"]
    if kind == "csv":
        known = ("separator", "encoding", "header", "na_values", "schema", "multiline")
        options = {name: config[name] for name in known if name in config}
        return files.read_csv(spark, config["file_path"], **{**options, **read})
    if kind == "parquet":
        return files.read_parquet(spark, config["file_path"], **read)
    return jdbc.read_jdbc(spark, config, **read)


def ingest_source(
    spark: SparkSession,
    config: Mapping[str, Any],
    target: str,
    tenant_id: str,
    as_of: dt.datetime | None = None,
    limits: quality.Limits | None = quality.Limits(),
    load_id: str | None = None,
    **read: Any,
) -> Ingestion:
    """Check that a described source can be read, then ingest it."""
    kind = config["type"]
    if kind in ("csv", "parquet"):
        ok, reason = files.check_source(spark, config["file_path"], kind)
    else:
        ok, reason = jdbc.check_connection(spark, config)
    if not ok:
        raise RuntimeError(f"cannot read the source: {reason}")
    return ingest(read_source(spark, config, **read), target, tenant_id, kind, as_of, limits, load_id=load_id)


def upload(
    df: DataFrame,
    table: str,
    target: str = sinks.LOCAL,
    mode: str = "append",
    registry: str | None = None,
    tenant_id: str = "default-tenant",
    as_of: dt.datetime | None = None,
    settled: bool = False,
) -> str:
    """Store an uploaded frame; ``mode`` is ``append`` or ``replace``, whatever its size.

    A lake target stores what has no lake type as text. With a registry the
    dataset is recorded there; with ``settled`` views and a snapshot of the
    table's namespace follow. Returns the size class of the upload, which is
    only a label.
    """
    if target not in (sinks.LOCAL, sinks.LAKE):
        raise ValueError(f"unknown target {target!r}")
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    seen = Observation()
    rows = (layout.coerce_types(df) if target == sinks.LAKE else df).observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode == "replace":
        sinks.overwrite(rows, table)
    else:
        sinks.append_or_create(rows, table)
    count = seen.get["rows"]
    moment = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if settled:
        settle(df.sparkSession, table, moment)
    if registry:
        catalog.register_dataset(
            df.sparkSession, registry, tenant_id, table, target, count, len(df.columns), moment
        )
    return "large" if count > layout.UPLOAD_ROWS else "small"


def run_models(
    spark: SparkSession,
    source: DataFrame,
    namespace: str,
    tie_break: str,
    as_of: dt.datetime | None = None,
) -> dict[str, str]:
    """Staging views and mart tables in dependency order; returns their names.

    Temporary views have no namespace of their own, so theirs carries it: runs
    for two tenants in one session do not see each other's rows.
    """
    names = {}

    def place(name: str, df: DataFrame, kind: str) -> DataFrame:
        names[name] = f"{namespace}_{name}" if kind == "view" else f"{namespace}.{name}"
        maintenance.materialize(df, names[name], kind)
        return spark.table(names[name])

    stg_rev = place("stg_rev", m.stg_rev(source), "view")
    place("mart_rev_metrics", m.mart_rev_metrics(stg_rev), "table")
    place("mart_rev_summary", m.mart_rev_summary(stg_rev), "table")
    place("stg_healthcare_data", m.stg_health(source, tie_break, as_of), "view")
    mart = m.mart_disease_analytics(m.clean_health(source, as_of), as_of)
    place("mart_disease_analytics", mart, "table")
    return names
