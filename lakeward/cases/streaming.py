"""Incremental forms: file stream with idempotent batches, maintained view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.models import PATIENT_DAILY
from lakeward.plans.fixtures import AS_OF, Tables, oracle
from lakeward.session import fresh_path
from lakeward.streaming import ingest, mview


@case(
    "src_csv_chunks",
    """select c_custkey, c_name, case when c_acctbal >= 2000 then c_nationkey end as nation, c_mktsegment,
  'tenant_a' as tenant_id, timestamp '2024-02-10 00:00:00' as ingestion_timestamp, 'csv' as source_type from customer""",
)
def csv_chunks(t: Tables) -> DataFrame:
    """Chunks with missing-value tokens and typed columns, as the batch reader reads them."""
    arriving, target, checkpoint = (fresh_path(t.spark, n) for n in ("arriving", "target", "progress"))
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey").cast("string")
    tokens = F.when(balance < 0, "NA").when(balance < 1000, "null").when(balance < 2000, "n/a").otherwise(nation)
    rows = t.customer.select("c_custkey", "c_name", tokens.alias("nation"), "c_mktsegment")
    rows.repartition(4).write.csv(arriving, header=True)
    schema = "c_custkey bigint, c_name string, nation int, c_mktsegment string"
    stream = ingest.csv_stream(t.spark, arriving, schema, max_files=2)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream, target, checkpoint, "tenant_a", "csv", AS_OF)
    return ingest.ingested(t.spark, target).drop("batch_id")


# Whole days: the window is cut when the view is read.
_DAYS = PATIENT_DAILY.replace("recorded_at >= timestamp", "date_trunc('day', recorded_at) >= timestamp")


@case("mat_mview_incremental", oracle(_DAYS, "patient_data"))
def incremental_view(t: Tables) -> DataFrame:
    arriving, target, checkpoint = (fresh_path(t.spark, n) for n in ("arriving", "figures", "progress"))
    rows = t.patient_data
    early = F.col("recorded_at") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    rows.filter(early).write.parquet(arriving)
    stream = ingest.file_stream(t.spark, arriving, rows.schema)
    mview.refresh(stream, target, checkpoint)
    rows.filter(~early).write.mode("append").parquet(arriving)
    mview.refresh(stream, target, checkpoint)
    mview.fold(t.spark, target)
    return mview.current(t.spark, target, AS_OF)
