"""Projections, filters, joins, sorts and set operations (one query each)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.functions import columns as c
from lakeward.operators import joins, layout, ranking
from lakeward.plans import models as m
from lakeward.plans.fixtures import AS_OF, Tables, oracle
from lakeward.sources import tables as src


@case("prj_select", "select o_orderkey, o_custkey as customer, o_totalprice from orders")
def select(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("customer"), "o_totalprice")


@case(
    "prj_quoted",
    oracle(
        """with spaced as (select disease as "Disease", blood_pressure as "Blood Pressure",
  cholesterol_level as "Cholesterol Level", difficulty_breathing as "Difficulty Breathing" from rev)
select "Disease", "Blood Pressure", "Cholesterol Level",
  case when "Difficulty Breathing" = 'Yes' then 1 else 0 end as breath_flag from spaced""",
        "rev",
    ),
)
def quoted(t: Tables) -> DataFrame:
    spaced = t.rev.select(
        F.col("disease").alias("Disease"),
        F.col("blood_pressure").alias("Blood Pressure"),
        F.col("cholesterol_level").alias("Cholesterol Level"),
        F.col("difficulty_breathing").alias("Difficulty Breathing"),
    )
    return spaced.select(
        "Disease",
        "`Blood Pressure`",
        "`Cholesterol Level`",
        c.flag_exact("`Difficulty Breathing`").alias("breath_flag"),
    )


@case(
    "prj_flag_strict",
    oracle("select row_key, case when fever = 'Yes' then 1 else 0 end as fever_flag from rev", "rev"),
)
def flag_strict(t: Tables) -> DataFrame:
    return t.rev.select("row_key", c.flag_exact("fever").alias("fever_flag"))


@case(
    "prj_flag_norm",
    oracle(
        "select row_key, case when trim(upper(difficulty_breathing)) = 'YES' then 1 else 0 end as breath from rev",
        "rev",
    ),
)
def flag_norm(t: Tables) -> DataFrame:
    return t.rev.select("row_key", c.flag("difficulty_breathing").alias("breath"))


@case(
    "prj_tristate",
    oracle(
        """select row_key, case when outcome_variable = 'Positive' then 1
  when outcome_variable = 'Negative' then 0 else null end as outcome_binary from rev""",
        "rev",
    ),
)
def tristate(t: Tables) -> DataFrame:
    return t.rev.select(
        "row_key", c.tristate("outcome_variable", "Positive", "Negative").alias("outcome_binary")
    )


@case("prj_normalize", oracle("select row_key, trim(upper(disease)) as disease_name from rev", "rev"))
def normalize(t: Tables) -> DataFrame:
    return t.rev.select("row_key", c.normalize("disease").alias("disease_name"))


@case(
    "prj_flag_sum",
    oracle(
        """select row_key, case when trim(upper(fever)) = 'YES' then 1 else 0 end
  + case when trim(upper(cough)) = 'YES' then 1 else 0 end
  + case when trim(upper(fatigue)) = 'YES' then 1 else 0 end as symptoms from rev""",
        "rev",
    ),
)
def flag_sum(t: Tables) -> DataFrame:
    flags = [c.flag(name) for name in ["fever", "cough", "fatigue"]]
    return t.rev.select("row_key", c.total(flags).alias("symptoms"))


@case(
    "prj_band",
    oracle(
        "select row_key, case when age < 18 then 'Child' when age < 65 then 'Adult' else 'Senior' end as age_group from rev",
        "rev",
    ),
)
def band(t: Tables) -> DataFrame:
    return t.rev.select("row_key", c.age_group("age").alias("age_group"))


@case(
    "prj_agg_band",
    """with shares as (select o_custkey,
  round(cast(count(case when o_orderstatus = 'F' then 1 end) as double) / cast(count(*) as double) * 100, 2) as share
  from orders group by o_custkey)
select o_custkey, share, case when share > 75 then 'High Risk' when share > 50 then 'Medium Risk' else 'Low Risk' end as risk
from shares""",
)
def agg_band(t: Tables) -> DataFrame:
    share = c.share_of_rows(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(share.alias("share"), c.risk_band(share).alias("risk"))


@case(
    "prj_cast",
    """select o_orderkey, cast(o_totalprice as double) as price, cast(round(o_totalprice) as integer) as whole_price,
  cast(o_orderdate as date) as order_day, cast(o_orderkey as varchar) as key_text,
  try_cast(round(try_cast(substr(o_orderpriority, 1, 1) as double)) as integer) as priority_number
from orders""",
)
def cast(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").cast("double").alias("price"),
        c.rounded_int("o_totalprice").alias("whole_price"),
        F.col("o_orderdate").cast("date").alias("order_day"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        c.lenient_int(F.substring("o_orderpriority", 1, 1)).alias("priority_number"),
    )


@case(
    "prj_literal",
    "select event_id, 'duckdb' as source_system, cast(null as double) as rate, cast(null as timestamp) as updated_at from events",
)
def literal(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.lit("duckdb").alias("source_system"),
        F.lit(None).cast("double").alias("rate"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


@case("prj_now", "select event_id, timestamp '2024-02-10 00:00:00' as processed_at from events")
def now(t: Tables) -> DataFrame:
    return t.events.select("event_id", c.moment(AS_OF).alias("processed_at"))


@case(
    "prj_tenant",
    """select *, 'tenant_a' as tenant_id, timestamp '2024-02-10 00:00:00' as ingestion_timestamp, 'parquet' as source_type
from events""",
)
def tenant(t: Tables) -> DataFrame:
    return layout.stamp(t.events, "tenant_a", "parquet", AS_OF)


@case(
    "prj_coerce",
    """select o_orderkey, o_totalprice, strftime(cast(o_orderdate as date), '%Y-%m-%d') as order_day,
  cast(o_orderkey % 2 = 0 as boolean) as even, cast(o_custkey as integer) as customer,
  cast(cast(o_custkey as integer) as varchar) as small_text
from orders""",
)
def coerce(t: Tables) -> DataFrame:
    mixed = t.orders.select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("order_day"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
        F.col("o_custkey").cast("int").alias("customer"),
        F.col("o_custkey").cast("decimal(12,0)").alias("small_text"),
    )
    return layout.coerce_types(mixed)


@case(
    "flt_not_null",
    oracle(
        """select row_key, disease, age, gender, outcome_variable from rev
where disease is not null and age is not null and gender is not null and outcome_variable is not null""",
        "rev",
    ),
)
def not_null(t: Tables) -> DataFrame:
    return t.rev.filter(c.present(m.REQUIRED)).select("row_key", *m.REQUIRED)


@case(
    "flt_recent",
    "select event_id, ts from events where ts >= timestamp '2024-02-10 00:00:00' - interval '30' day",
)
def recent(t: Tables) -> DataFrame:
    return m.recent(t.events, "ts", 30, AS_OF).select("event_id", "ts")


@case(
    "flt_cmp",
    """select event_id, event_type, value from events
where (event_type = 'click' and value > 40) or (event_type <> 'view' and value < 5) or user_id >= 90""",
)
def compare(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    wanted = ((kind == "click") & (value > 40)) | ((kind != "view") & (value < 5)) | (F.col("user_id") >= 90)
    return t.events.filter(wanted).select("event_id", "event_type", "value")


@case(
    "flt_not_in",
    oracle(
        """select coalesce(outcome_variable, 'none') as outcome, count(*) as n from rev
where outcome_variable not in ('Positive', 'Negative') or outcome_variable is null
group by coalesce(outcome_variable, 'none')""",
        "rev",
    ),
)
def not_in(t: Tables) -> DataFrame:
    outcome = F.col("outcome_variable")
    outside = ~outcome.isin("Positive", "Negative") | outcome.isNull()
    named = F.coalesce(outcome, F.lit("none")).alias("outcome")
    return t.rev.filter(outside).groupBy(named).agg(F.count(F.lit(1)).alias("n"))


@case(
    "flt_params",
    "select event_id, value from events where event_type = 'purchase' and value >= 25.5",
)
def params(t: Tables) -> DataFrame:
    path = src.quoted(t.path("events"))
    return src.scan(
        t.spark,
        "events",
        query=f"select event_id, value from parquet.{path} where event_type = :kind and value >= :least",
        args={"kind": "purchase", "least": 25.5},
    )


@case(
    "join_left_expr",
    oracle(
        """with summary as (select trim(upper(disease)) as disease_name, count(*) as total_cases
  from rev where disease is not null group by trim(upper(disease)))
select i.patient_id, i.disease, d.total_cases from patient_data i left join summary d on upper(i.disease) = d.disease_name""",
        "rev",
        "patient_data",
    ),
)
def left_on_expression(t: Tables) -> DataFrame:
    named = t.rev.filter(F.col("disease").isNotNull())
    summary = named.groupBy(c.normalize("disease").alias("disease_name")).agg(
        F.count(F.lit(1)).alias("total_cases")
    )
    joined = joins.join_summary(t.patient_data, summary, F.upper("disease") == F.col("disease_name"))
    return joined.select("patient_id", "disease", "total_cases")


@case(
    "join_inner",
    """select l_orderkey, l_linenumber, o_custkey, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey""",
)
def inner(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", "l_extendedprice")


@case(
    "join_semi",
    "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)",
)
def semi(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 5000")
    matched = t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return matched.select("o_orderkey", "o_totalprice")


CATALOGS = """catalogs as (select concat('tenant_', cast(min(c_nationkey) as varchar)) as tenant_id, c_mktsegment as catalog_name
  from customer group by c_mktsegment)"""


def _catalogs(t: Tables) -> DataFrame:
    owner = F.concat(F.lit("tenant_"), F.min("c_nationkey").cast("string"))
    return t.customer.groupBy(F.col("c_mktsegment").alias("catalog_name")).agg(owner.alias("tenant_id"))


@case(
    "join_lookup",
    oracle(
        f"""with {CATALOGS}
select patient_id, upper(disease) as lookup_key, tenant_id from patient_data
join catalogs on upper(disease) = catalog_name""",
        "patient_data",
    ),
)
def lookup(t: Tables) -> DataFrame:
    found, _ = joins.lookup(t.patient_data, _catalogs(t), F.upper("disease"), "catalog_name")
    return found.select("patient_id", "lookup_key", "tenant_id")


@case(
    "join_lookup_missing",
    oracle(
        f"""with {CATALOGS}
select upper(disease) as lookup_key, count(*) as rows from patient_data
where upper(disease) not in (select catalog_name from catalogs) group by upper(disease)""",
        "patient_data",
    ),
)
def lookup_missing(t: Tables) -> DataFrame:
    _, missing = joins.lookup(t.patient_data, _catalogs(t), F.upper("disease"), "catalog_name")
    return missing


@case(
    "win_row_id",
    oracle(
        """select row_key, disease, age, gender,
  row_number() over (order by disease nulls last, age nulls last, gender nulls last, row_key) as patient_id from rev""",
        "rev",
    ),
)
def row_id(t: Tables) -> DataFrame:
    order = [F.col(n).asc_nulls_last() for n in ["disease", "age", "gender", "row_key"]]
    return ranking.number_rows(t.rev.select("row_key", "disease", "age", "gender"), order, "patient_id")


@case(
    "win_rank_metrics",
    """with metrics as (select p_type, p_brand, count(*) as n, sum(cast(p_size as bigint))::bigint as size_sum
  from part group by p_type, p_brand)
select *, row_number() over (order by n desc, p_type, p_brand) as volume_rank,
  row_number() over (order by size_sum desc, p_type, p_brand) as size_rank from metrics""",
)
def rank_metrics(t: Tables) -> DataFrame:
    names = [("p_type", False), ("p_brand", False)]
    metrics = t.part.groupBy("p_type", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size_sum")
    )
    return ranking.add_ranks(metrics, {"volume_rank": [("n", True), *names], "size_rank": [("size_sum", True), *names]})


@case(
    "win_rank",
    """select l_orderkey, l_linenumber, l_returnflag, l_quantity,
  rank() over (partition by l_returnflag order by l_quantity desc nulls last) as quantity_rank from lineitem""",
)
def rank(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return ranking.rank_within(rows, ["l_returnflag"], "l_quantity", "quantity_rank", descending=True)


@case(
    "win_row_number",
    """select event_id, event_type, ts,
  row_number() over (partition by event_type order by ts nulls last, event_id) as event_number from events""",
)
def row_number(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts")
    order = [F.col("ts").asc_nulls_last(), F.col("event_id")]
    return ranking.number_within(rows, ["event_type"], order, "event_number")


@case(
    "win_partition_agg",
    oracle(
        """select row_key, disease, gender, age, count(*) over (partition by disease, gender) as cases,
  avg(age) over (partition by disease, gender) as group_age from rev""",
        "rev",
    ),
)
def partition_aggregate(t: Tables) -> DataFrame:
    rows = t.rev.select("row_key", "disease", "gender", "age")
    return joins.with_group_totals(
        rows, ["disease", "gender"], F.count(F.lit(1)).alias("cases"), F.avg("age").alias("group_age")
    )


@case(
    "win_last_n",
    """select event_id, event_type, ts from events
qualify row_number() over (partition by event_type order by ts desc nulls last, event_id desc) <= 1000""",
)
def last_n(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts")
    newest = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    return ranking.top_per_key(rows, ["event_type"], newest, 1000)


@case(
    "ord_sort",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey",
)
def sort(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())


@case("ord_limit", "select event_id, ts, event_type from events order by event_id limit 100")
def limit(t: Tables) -> DataFrame:
    return src.sample(t.events.select("event_id", "ts", "event_type"), 100, F.col("event_id").asc_nulls_last())


@case(
    "ord_topk",
    oracle(
        """select query_id, tenant_id, state, created, latency_us from query_log where state <> 'FINISHED'
order by created desc, query_id desc limit 5""",
        "query_log",
    ),
)
def top_k(t: Tables) -> DataFrame:
    running = t.query_log.filter("state <> 'FINISHED'")
    columns = ["query_id", "tenant_id", "state", "created", "latency_us"]
    newest = [F.col("created").desc_nulls_last(), F.col("query_id").desc()]
    return src.sample(running.select(columns), 5, *newest)


@case(
    "set_union_all",
    """select 'orders' as source, o_custkey as customer, o_totalprice as amount from orders
union all select 'customer', c_custkey, c_acctbal from customer
union all select 'events', user_id, value from events""",
)
def union_all(t: Tables) -> DataFrame:
    parts = [
        t.orders.select(F.lit("orders").alias("source"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount")),
        t.customer.select(F.lit("customer"), "c_custkey", "c_acctbal"),
        t.events.select(F.lit("events"), "user_id", "value"),
    ]
    return reduce(DataFrame.union, parts)


@case("set_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
def distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@case(
    "set_concat",
    "select event_id, ts, date_trunc('day', ts) as chunk from events",
)
def concat(t: Tables) -> DataFrame:
    # Chunks of a load, united again: one part per ten days of events.
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21)]
    kind = t.events.schema["ts"].dataType
    borders = [None, *[c.timestamp_literal(day, kind) for day in days[1:]], None]
    parts = []
    for low, high in zip(borders, borders[1:]):
        part = t.events.select("event_id", "ts", c.trunc_to("day", "ts", t.events).alias("chunk"))
        part = part if low is None else part.filter(F.col("ts") >= low)
        part = part if high is None else part.filter(F.col("ts") < high)
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)
