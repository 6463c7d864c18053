"""Billing, counters, response times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.support import namespace
from lakeward.operators import metering
from lakeward.operators.sinks import append_or_create
from lakeward.plans.fixtures import Tables, oracle


@case(
    "agg_billing",
    oracle(
        """select tenant_id, count(*) as total_bill_events, cast(sum(greatest(1, row_count // 1000)) as bigint) as total_amount
from query_log where bill group by tenant_id""",
        "query_log",
    ),
)
def billing(t: Tables) -> DataFrame:
    return metering.billing(t.query_log)


@case(
    "agg_billing_events",
    oracle(
        "select tenant_id, created as ts, greatest(1, row_count // 1000) as amount, engine as type from query_log where bill",
        "query_log",
    ),
)
def billing_events(t: Tables) -> DataFrame:
    return metering.billing_events(t.query_log)


@case(
    "agg_counters",
    oracle(
        """select 'requests_total' as metric, count(*) as value from query_log
union all select 'requests_failed', count(case when state = 'FAILED' then 1 end) from query_log
union all select 'data_volume_processed', cast(sum(row_count) as bigint) from query_log
union all select 'tables_created', count(case when upper(ltrim(query)) like 'CREATE%' then 1 end) from query_log
union all select 'tables_updated', count(case when upper(ltrim(query)) like 'INSERT%' or upper(ltrim(query)) like 'UPDATE%' then 1 end) from query_log""",
        "query_log",
    ),
)
def counters(t: Tables) -> DataFrame:
    return metering.counters(metering.metric_events(t.query_log))


@case(
    "agg_response",
    oracle(
        """select avg(latency_us) as avg_response_time, max(latency_us) as max_response_time, min(latency_us) as min_response_time,
  count(latency_us) as measurements from (select latency_us from query_log order by created desc, query_id desc limit 1000)""",
        "query_log",
    ),
)
def response(t: Tables) -> DataFrame:
    return metering.response_times(t.query_log, "created", "latency_us", "query_id")


# One tenant is unknown to the tenant table.
_KNOWN = "tenant_id <> (select max(tenant_id) from query_log)"


@case(
    "wl_log",
    oracle(
        f"""select query_id, tenant_id, query, substring(query, 1, 200) as short_query, engine,
  nullif(regexp_extract(query, '\\b(?:from|into|update|table)\\s+([a-z_][a-z0-9_.]*)', 1, 'i'), '') as "table",
  row_count as rows, latency_us, created as ts from query_log where {_KNOWN}""",
        "query_log",
    ),
)
def log(t: Tables) -> DataFrame:
    table = f"{namespace(t.spark)}.query_log"
    last = t.query_log.agg(F.max("tenant_id")).first()[0]
    tenants = t.query_log.select("tenant_id").where(F.col("tenant_id") != last)
    append_or_create(metering.log_entries(t.query_log, tenants), table)
    return t.spark.table(table)
