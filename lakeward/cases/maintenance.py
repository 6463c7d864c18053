"""Table maintenance: materialized views, compaction, snapshots, namespaces."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.models import PATIENT_DAILY
from lakeward.cases.support import namespace
from lakeward.functions import columns as c
from lakeward.operators import maintenance, sinks, views
from lakeward.plans import models as m
from lakeward.plans.fixtures import AS_OF, Tables, oracle
from lakeward.session import fresh_path, stage

HOUR = dt.timedelta(hours=1)


@case("mat_mview", oracle(PATIENT_DAILY, "patient_data"))
def materialized_view(t: Tables) -> DataFrame:
    name = f"{namespace(t.spark)}.patient_analytics"

    def build() -> DataFrame:
        return m.patient_daily(t.patient_data, AS_OF)

    maintenance.refresh_view(t.spark, name, build, AS_OF)
    maintenance.refresh_view(t.spark, name, build, AS_OF + HOUR / 2)  # too early: does nothing
    maintenance.refresh_view(t.spark, name, build, AS_OF + HOUR)
    return t.spark.table(name)


# Whole days: every partition of the table is a day.
_DAYS = PATIENT_DAILY.replace("recorded_at >= timestamp", "date_trunc('day', recorded_at) >= timestamp")


@case("mat_mview_delta", oracle(_DAYS, "patient_data"))
def changed_view(t: Tables) -> DataFrame:
    """A view over a table by month that is loaded, changed and changed back, and refreshed after each."""
    table, path = fresh_path(t.spark, "patients"), fresh_path(t.spark, "view")
    age, rows = c.json_value("demographics", "age", "int"), t.patient_data
    day = c.trunc_to("day", "recorded_at", rows)
    daily = views.View(
        keys={"disease": F.col("disease"), "recorded_date": F.col("recorded_date")},
        sums={"positive": F.coalesce(F.col("outcome") == "Positive", F.lit(False)).cast("int"), "age_sum": age, "age_count": age.isNotNull().cast("int")},
        shown={
            "total_cases": F.col("_rows"),
            "positivity_rate": F.try_divide(F.col("positive").cast("double"), F.col("_rows")),
            "avg_age": F.try_divide(F.col("age_sum").cast("double"), F.col("age_count")),
        },
    )
    recent = rows.withColumn("recorded_date", day).where(F.col("recorded_date") >= F.lit(AS_OF - dt.timedelta(days=30)))
    parted = recent.withColumn("slice", F.pmod(F.hash("patient_id"), F.lit(4)))

    def write(df: DataFrame) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slice").parquet(table)
        views.refresh(t.spark.read.parquet(table), daily, path, ["slice"])

    write(parted.where("slice < 3"))
    write(parted.where("slice = 1").withColumn("outcome", F.lit("Positive")))  # an update
    write(parted.where("slice in (1, 3)"))  # undone, and an append
    return views.current(t.spark, daily, path)


@case("maint_compact", "select event_id, user_id, event_type, value from events")
def compact(t: Tables) -> DataFrame:
    name = f"{namespace(t.spark)}.events"
    columns = ["event_id", "user_id", "event_type", "value"]
    maintenance.publish(t.events.select(columns).repartition(16), name)
    if not maintenance.compact(t.spark, name):
        raise RuntimeError("many small files were left as they are")
    return t.spark.table(name)


@case(
    "maint_compact_partitioned",
    "select event_type, count(*) as rows, 1::bigint as files from events group by event_type",
)
def compact_partitioned(t: Tables) -> DataFrame:
    name = f"{namespace(t.spark)}.events"
    rows = t.events.select("event_id", "value", "event_type").repartition(8)
    maintenance.publish(rows, name, partition_by=("event_type",))
    maintenance.compact(t.spark, name)
    counted = t.spark.table(name).groupBy("event_type", "_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"))


LIFE = """select o_orderkey, o_custkey, case when o_orderstatus = 'P' then 'X' else o_orderstatus end as o_orderstatus, o_totalprice
from orders where not (o_totalprice > 300000)
union all select c_custkey, c_custkey, 'new', c_acctbal from customer"""


def _life(t: Tables, partition_by: tuple[str, ...]) -> DataFrame:
    """A table made by a sink, then appended to, updated, deleted from, compacted, appended to, refreshed."""
    name = f"{namespace(t.spark)}.orders"
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = t.orders.select(columns)
    low, high = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0")
    if partition_by:
        maintenance.publish(low, name, partition_by=partition_by)
    else:
        sinks.append_or_create(low, name)
    sinks.append_or_create(high, name, by_name=True)
    maintenance.update_rows(t.spark, name, F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("X")})
    maintenance.delete_rows(t.spark, name, F.col("o_totalprice") > 300000)
    maintenance.compact(t.spark, name)
    more = t.customer.select(
        F.col("c_custkey").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"),
        F.lit("new").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"),
    )
    sinks.append_or_create(more, name, by_name=True)
    before = t.spark.table(name)
    if not maintenance.refresh_view(t.spark, name, lambda: before, AS_OF):
        raise RuntimeError("a table that was never refreshed is due")
    return t.spark.table(name).select(columns)


@case("maint_life", LIFE)
def life(t: Tables) -> DataFrame:
    return _life(t, ())


@case("maint_life_partitioned", LIFE)
def life_partitioned(t: Tables) -> DataFrame:
    return _life(t, ("o_orderstatus",))


@case(
    "maint_snapshot",
    """select '20240201_000000' as snapshot_ts, p_partkey, p_size from part
union all select '20240210_000000', p_partkey, p_size from part""",
)
def snapshot(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.part.select("p_partkey", "p_size").write.saveAsTable(f"{ns}.part")
    maintenance.snapshot(t.spark, ns, dt.datetime(2024, 2, 1))
    maintenance.snapshot(t.spark, ns, AS_OF)
    maintenance.snapshot(t.spark, ns, AS_OF)  # a rerun replaces its copy
    stamps = [r.snapshot_ts for r in maintenance.history(t.spark, f"{ns}.part").collect()]
    parts = [maintenance.read_snapshot(t.spark, f"{ns}.part", s).select(F.lit(s).alias("snapshot_ts"), "p_partkey", "p_size") for s in stamps]
    return reduce(DataFrame.unionByName, parts)


@case("maint_expire", "select '20240210_000000' as snapshot_ts, count(*) as rows from part")
def expire(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.part.select("p_partkey", "p_size").write.saveAsTable(f"{ns}.part")
    for day in (dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 2), AS_OF):
        maintenance.snapshot(t.spark, ns, day)
    maintenance.expire_snapshots(t.spark, f"{ns}.part", AS_OF, "7d")
    return maintenance.history(t.spark, f"{ns}.part")


@case(
    "meta_history",
    """select '20240210_000000' as snapshot_ts, count(*) as rows from customer
union all select '20240201_000000', count(*) from customer where c_acctbal > 0""",
)
def history(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.customer.filter("c_acctbal > 0").write.saveAsTable(f"{ns}.customer")
    maintenance.snapshot(t.spark, ns, dt.datetime(2024, 2, 1))
    t.customer.filter("not coalesce(c_acctbal > 0, false)").write.insertInto(f"{ns}.customer")
    maintenance.snapshot(t.spark, ns, AS_OF)
    return maintenance.history(t.spark, f"{ns}.customer")


@case(
    "ns_create_drop",
    "select 'dropped' as state, c_mktsegment, count(*) as n from customer group by c_mktsegment",
)
def create_drop(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    maintenance.create_namespace(t.spark, ns)  # a second time changes nothing
    t.customer.select("c_mktsegment").write.saveAsTable(f"{ns}.segments")
    counted = t.spark.table(f"{ns}.segments").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    kept = stage(counted, "counted")
    maintenance.drop_namespace(t.spark, ns)
    state = "present" if t.spark.catalog.databaseExists(ns) else "dropped"
    return kept.select(F.lit(state).alias("state"), "c_mktsegment", "n")
