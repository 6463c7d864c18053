"""Aggregations (one query each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.functions import columns as c
from lakeward.operators import ranking
from lakeward.operators.quality import column_values
from lakeward.plans.fixtures import Tables, oracle


@case("agg_count", "select count(*) as total_records from lineitem")
def count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("total_records"))


@case("agg_group_count", "select l_shipdate, count(*) as n from lineitem group by l_shipdate order by n desc, l_shipdate")
def group_count(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc_nulls_last("n"), F.asc_nulls_last("l_shipdate"))


@case(
    "agg_count_if",
    """select l_suppkey, count(case when l_returnflag = 'R' then 1 end) as returned,
  count(case when l_quantity > 25 then 1 end) as bulky from lineitem group by l_suppkey""",
)
def count_if(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_quantity") > 25).alias("bulky"),
    )


@case(
    "agg_pct",
    """select l_linestatus, round(cast(count(case when l_returnflag = 'R' then 1 end) as double) / cast(count(*) as double) * 100, 2) as returned_pct,
  round(cast(count(case when l_quantity > 25 then 1 end) as double) / cast(count(*) as double) * 100, 2) as bulky_pct
from lineitem group by l_linestatus""",
)
def share(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(
        c.share_of_rows(F.col("l_returnflag") == "R").alias("returned_pct"),
        c.share_of_rows(F.col("l_quantity") > 25).alias("bulky_pct"),
    )


@case(
    "agg_avg_flag",
    oracle(
        """select gender, avg(case when cough = 'YES' then 1 else 0 end) as cough_rate,
  round(avg(cast(case when fatigue = 'Yes' then 1 else 0 end as double)) * 100, 2) as fatigue_pct from rev group by gender""",
        "rev",
    ),
)
def average_flag(t: Tables) -> DataFrame:
    return t.rev.groupBy("gender").agg(
        F.avg(c.flag_exact("cough", "YES")).alias("cough_rate"),
        F.round(F.avg(c.flag_exact("fatigue").cast("double")) * 100, 2).alias("fatigue_pct"),
    )


@case(
    "agg_avg_min_max",
    """select o_orderpriority, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 / count(*) as avg_price,
  min(o_totalprice) as min_price, max(o_totalprice) as max_price from orders group by o_orderpriority""",
)
def average_min_max(t: Tables) -> DataFrame:
    # Summed in whole cents: a sum of doubles depends on the order of the rows.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return t.orders.groupBy("o_orderpriority").agg(
        (cents.cast("double") / 100 / F.count(F.lit(1))).alias("avg_price"),
        F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"),
    )


@case(
    "agg_avg_case",
    oracle(
        """select disease, avg(case when outcome = 'Positive' then cast(1 as double) else cast(0 as double) end) as positivity_rate
from patient_data group by disease""",
        "patient_data",
    ),
)
def average_case(t: Tables) -> DataFrame:
    positive = F.when(F.col("outcome") == "Positive", 1.0).otherwise(0.0)
    return t.patient_data.groupBy("disease").agg(F.avg(positive).alias("positivity_rate"))


@case(
    "agg_json_avg",
    oracle(
        """select disease, avg(cast(json_extract_string(demographics, '$.age') as integer)) as avg_age,
  count(json_extract_string(demographics, '$.age')) as known from patient_data group by disease""",
        "patient_data",
    ),
)
def json_average(t: Tables) -> DataFrame:
    age = c.json_value("demographics", "age", "int")
    return t.patient_data.groupBy("disease").agg(F.avg(age).alias("avg_age"), F.count(age).alias("known"))


@case(
    "agg_multi_key",
    """select l_returnflag, l_linestatus, l_suppkey, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
from lineitem group by l_returnflag, l_linestatus, l_suppkey""",
)
def multi_key(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


@case(
    "agg_by_expr",
    """select event_type, date_trunc('day', ts) as day, count(*) as n, max(value) as highest
from events group by event_type, date_trunc('day', ts)""",
)
def by_expression(t: Tables) -> DataFrame:
    day = c.trunc_to("day", "ts", t.events).alias("day")
    return t.events.groupBy("event_type", day).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("highest")
    )


@case("agg_sum", "select l_suppkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from lineitem group by l_suppkey")
def total(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(cents).alias("cents"))


@case(
    "agg_distinct",
    """select l_returnflag, count(distinct l_partkey) as parts,
  cast(sum(distinct cast(l_quantity as bigint)) as bigint) as quantities from lineitem group by l_returnflag""",
)
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.sum_distinct(F.col("l_quantity").cast("bigint")).alias("quantities"),
    )


@case(
    "agg_having",
    "select o_custkey, count(*) as orders from orders group by o_custkey having count(*) > 10",
)
def having(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return counted.filter("orders > 10")


@case(
    "agg_distinct_values",
    oracle("select distinct outcome_variable from rev where outcome_variable is not null order by outcome_variable", "rev"),
)
def distinct_values(t: Tables) -> DataFrame:
    return column_values(t.rev, "outcome_variable")


@case(
    "agg_array",
    """with numbered as (select event_type, value, row_number() over (partition by event_type order by value nulls last, event_id) as n from events),
chunks as (select event_type, cast((n - 1) // 1000 as bigint) as chunk, list(value order by n) as members, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
  from numbered group by event_type, cast((n - 1) // 1000 as bigint))
select event_type, chunk, cast(len(members) as bigint) as size, members[1] as first_value, members[len(members)] as last_value, cents
from chunks""",
)
def array(t: Tables) -> DataFrame:
    chunks = ranking.array_chunks(t.events, ["event_type"], "value", "event_id", "members")
    cents = F.transform("members", lambda v: F.round(v * 100).cast("bigint"))
    return chunks.select(
        "event_type",
        "chunk",
        F.size("members").cast("bigint").alias("size"),
        F.element_at("members", 1).alias("first_value"),
        F.element_at("members", -1).alias("last_value"),
        F.aggregate(cents, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("cents"),
    )
