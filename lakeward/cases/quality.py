"""Data-quality checks (one query each)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.models import STG_REV, with_health
from lakeward.cases.support import namespace
from lakeward.operators import layout, maintenance, quality as q
from lakeward.plans import expectations, models as m
from lakeward.plans.fixtures import AS_OF, Tables, oracle


@case("dq_not_null", oracle("select row_key, disease, gender from rev where age is null", "rev"))
def not_null(t: Tables) -> DataFrame:
    return q.null_rows(t.rev, "age").select("row_key", "disease", "gender")


@case("dq_unique", "select l_orderkey, count(*) as n from lineitem where l_orderkey is not null group by l_orderkey having count(*) > 1")
def unique(t: Tables) -> DataFrame:
    return q.repeated(t.lineitem, "l_orderkey")


@case(
    "dq_accepted_values",
    oracle("select fever, count(*) as n from rev where fever not in ('Yes', 'No') group by fever", "rev"),
)
def accepted_values(t: Tables) -> DataFrame:
    return q.unexpected_values(t.rev, "fever", ["Yes", "No"])


@case(
    "dq_accepted_range",
    """select o_orderkey, o_totalprice from orders where not (o_totalprice between 5000 and 400000)""",
)
def accepted_range(t: Tables) -> DataFrame:
    return q.outside_range(t.orders, "o_totalprice", 5000, 400000).select("o_orderkey", "o_totalprice")


@case(
    "dq_unique_combo",
    oracle("select disease, age, gender, count(*) as n from rev group by disease, age, gender having count(*) > 1", "rev"),
)
def unique_combination(t: Tables) -> DataFrame:
    return q.repeated(t.rev, "disease", "age", "gender")


@case(
    "dq_freshness",
    """select 'events' as source, max(ts) as newest,
  case when max(ts) < timestamp '2024-02-10 00:00:00' - interval '30' day then 'error'
       when max(ts) < timestamp '2024-02-10 00:00:00' - interval '1' day then 'warn' else 'pass' end as status from events
union all
select 'orders', max(o_orderdate),
  case when max(o_orderdate) < timestamp '2024-02-10 00:00:00' - interval '3' day then 'error'
       when max(o_orderdate) < timestamp '2024-02-10 00:00:00' - interval '1' day then 'warn' else 'pass' end from orders""",
)
def freshness(t: Tables) -> DataFrame:
    day = dt.timedelta(days=1)
    events = q.freshness(t.events, "ts", day, 30 * day, AS_OF)
    orders = q.freshness(t.orders, "o_orderdate", day, 3 * day, AS_OF)
    return events.select(F.lit("events").alias("source"), "*").union(
        orders.select(F.lit("orders"), "*")
    )


def _profile_sql(name: str, accepted: str | None) -> str:
    def line(test: str, bad: str, over: str) -> str:
        return f"""select '{name}' as column_name, '{test}' as test_type, count(*) as total_rows,
  count(*) filter (where {bad}) as null_count, round(count(*) filter (where {bad}) / count(*) * 100, 2) as null_percentage
from rev where {over}"""

    lines = [line("null_count", f"{name} is null", "true")]
    if accepted:
        lines.append(line("unexpected_values", f"{name} not in {accepted}", f"{name} is not null"))
    return " union all ".join(lines)


@case(
    "dq_profile",
    oracle(
        " union all ".join(
            [
                _profile_sql("disease", None),
                _profile_sql("age", None),
                _profile_sql("fever", "('Yes', 'No')"),
                _profile_sql("gender", "('Male', 'Female')"),
                _profile_sql("outcome_variable", "('Positive', 'Negative')"),
            ]
        ),
        "rev",
    ),
)
def profile(t: Tables) -> DataFrame:
    return q.profile(
        t.rev,
        {
            "disease": None,
            "age": None,
            "fever": ["Yes", "No"],
            "gender": ["Male", "Female"],
            "outcome_variable": ["Positive", "Negative"],
        },
    )


@case(
    "dq_summary",
    with_health(
        """select 'stg_rev' as model_name, count(*) as total_rows, count(*) filter (where disease is null) as null_diseases,
  count(*) filter (where outcome_variable not in ('Positive', 'Negative')) as invalid_outcomes,
  count(*) filter (where age not between 5 and 120) as invalid_ages, 0::bigint as invalid_rates, 0::bigint as invalid_totals from rev
union all
select 'mart_disease_analytics', count(*), 0, 0, 0, count(*) filter (where positivity_rate not between 0 and 30),
  count(*) filter (where total_cases <= 0) from mart
having count(*) filter (where positivity_rate not between 0 and 30) > 0"""
    ),
)
def summary(t: Tables) -> DataFrame:
    # The models as they lie in their tables. Borders are tightened so that both have failures to report.
    ns = namespace(t.spark)
    maintenance.materialize(t.rev.select("disease", "age", "outcome_variable"), f"{ns}.stg_rev", "table")
    maintenance.materialize(m.disease_metrics(m.clean_health(t.rev, AS_OF), AS_OF), f"{ns}.mart", "table")
    return q.summary(
        {
            "stg_rev": (
                t.spark.table(f"{ns}.stg_rev"),
                {
                    "null_diseases": F.col("disease").isNull(),
                    "invalid_outcomes": ~F.col("outcome_variable").isin("Positive", "Negative"),
                    "invalid_ages": ~F.col("age").between(5, 120),
                },
            ),
            "mart_disease_analytics": (
                t.spark.table(f"{ns}.mart"),
                {
                    "null_diseases": F.col("disease_name").isNull(),
                    "invalid_rates": ~F.col("positivity_rate").between(0, 30),
                    "invalid_totals": F.col("total_cases") <= 0,
                },
            ),
        }
    )


SEVERITY = [
    q.Check("not_null", ("age",), severity="warn"),
    q.Check("accepted_values", ("gender",), ("Male", "Female")),
    q.Check("accepted_values", ("fever",), ("Yes", "No")),
]


@case(
    "dq_severity",
    oracle(
        """with counted as (
  select 'not_null_age' as check_name, 'warn' as severity, count(*) as failures from rev where age is null
  union all select 'accepted_values_gender', 'error', count(*) from rev where gender not in ('Male', 'Female')
  union all select 'accepted_values_fever', 'error', count(*) from rev where fever not in ('Yes', 'No'))
select *, case when failures > 0 then severity else 'pass' end as result from counted""",
        "rev",
    ),
)
def severity(t: Tables) -> DataFrame:
    return q.run_checks(t.rev, SEVERITY)  # one pass for all of them


@case(
    "dq_empty",
    """select 'unknown type' as part, count(*) = 0 as empty from events where event_type = 'no such type'
union all select 'all', count(*) = 0 from events""",
)
def empty(t: Tables) -> DataFrame:
    parts = {"unknown type": t.events.filter("event_type = 'no such type'"), "all": t.events}
    named = [df.agg(F.lit(n).alias("part"), (F.count(F.lit(1)) == 0).alias("empty")) for n, df in parts.items()]
    return named[0].union(named[1])


@case(
    "dq_all_null",
    """select column_name from (
  select 'never' as column_name, count(case when o_totalprice < 0 then 1 end) as filled from orders
  union all select 'sometimes', count(case when o_totalprice > 250000 then 1 end) from orders
  union all select 'o_orderkey', count(o_orderkey) from orders
  union all select 'nothing', 0) where filled = 0""",
)
def all_null(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return q.all_null_columns(
        t.orders.select(
            "o_orderkey",
            F.when(price < 0, price).alias("never"),
            F.when(price > 250000, price).alias("sometimes"),
            F.lit(None).cast("string").alias("nothing"),
        )
    )


_LINEITEM = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"""


@case(
    "dq_dup_rows",
    f"""with twice as (select {_LINEITEM} from lineitem union all select {_LINEITEM} from lineitem where l_linenumber = 1)
select cast(sum(n - 1) as bigint) as duplicate_rows from (select count(*) as n from twice group by {_LINEITEM})""",
)
def duplicate_rows(t: Tables) -> DataFrame:
    """Whole rows; those of the first line of each order are there twice."""
    return q.duplicate_rows(t.lineitem.unionByName(t.lineitem.where("l_linenumber = 1")))


MIXED = """case event_type when 'click' then cast(event_id as varchar) when 'view' then cast(value as varchar) || '5'
  when 'signup' then strftime(ts, '%Y-%m-%d') when 'error' then 'true' else event_type end"""


@case(
    "dq_mixed",
    f"""with texts as (select {MIXED} as mixed_text, event_type, cast(user_id as varchar) as user_text from events),
kinds as (select 'event_type' as column_name, event_type as v from texts union all select 'user_text', user_text from texts
  union all select 'mixed_text', mixed_text from texts),
typed as (select column_name, case when try_cast(v as bigint) is not null and v not like '%.%' then 'int'
  when try_cast(v as double) is not null then 'double' when try_cast(v as date) is not null then 'date'
  when v in ('true', 'false') then 'boolean' else 'text' end as kind from kinds where v is not null)
select column_name, string_agg(distinct kind, ',' order by kind) as kinds, count(distinct kind) > 1 as mixed from typed group by column_name""",
)
def mixed(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.col("event_id").cast("string"))
        .when(kind == "view", F.concat(F.col("value").cast("string"), F.lit("5")))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "error", "true")
        .otherwise(kind)
    )
    texts = t.events.select(text.alias("mixed_text"), "event_type", F.col("user_id").cast("string").alias("user_text"))
    found = q.mixed_columns(texts)
    return found.withColumn("kinds", F.concat_ws(",", F.sort_array("kinds")))


@case(
    "dq_size",
    """select cast(sum(8 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8) as bigint) as bytes,
  sum(8 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8) > 1000000 as too_large
from documents""",
)
def size(t: Tables) -> DataFrame:
    measured = layout.size_of(t.read("documents"))
    return measured.select("bytes", (F.col("bytes") > 1_000_000).alias("too_large"))


@case(
    "dq_issue_list",
    oracle(
        """with base as (select disease, gender, blood_pressure, age, cast(null as varchar) as note from rev)
select 'all_null' as issue, 'note' as column_name, count(*) as figure, 'column note holds only nulls' as message from base
union all
select 'duplicates', null, cast(sum(n - 1) as bigint), cast(cast(sum(n - 1) as bigint) as varchar) || ' repeated rows'
from (select count(*) as n from base group by disease, gender, blood_pressure, age, note)""",
        "rev",
    ),
)
def issue_list(t: Tables) -> DataFrame:
    base = t.rev.select("disease", "gender", "blood_pressure", "age", F.lit(None).cast("string").alias("note"))
    return q.issues(base)


def _checks_sql(checks: list[q.Check], table: str) -> str:
    lines = []
    for check in checks:
        column = check.columns[0]
        if check.kind == "unique":
            keys = ", ".join(check.columns)
            found = f"(select count(*) from (select 1 from {table} group by {keys} having count(*) > 1))"
        elif check.kind == "not_null":
            found = f"(select count(*) from {table} where {column} is null)"
        elif check.kind == "accepted_values":
            found = f"(select count(*) from {table} where {column} not in {check.values})"
        else:
            found = f"(select count(*) from {table} where {column} not between {check.values[0]} and {check.values[1]})"
        lines.append(f"select '{check.name}' as check_name, '{check.severity}' as severity, {found} as failures")
    return f"select *, if(failures > 0, severity, 'pass') as result from ({' union all '.join(lines)})"


@case("dq_source_checks", oracle(_checks_sql(expectations.REV, "rev"), "rev"))
def source_checks(t: Tables) -> DataFrame:
    return q.run_checks(t.rev, expectations.REV)


@case("dq_lake_checks", oracle(_checks_sql(expectations.PATIENT_DATA, "patient_data"), "patient_data"))
def lake_checks(t: Tables) -> DataFrame:
    return q.run_checks(t.patient_data, expectations.PATIENT_DATA)


@case(
    "dq_model_checks",
    oracle(_checks_sql(expectations.DISEASE_TRENDS, "disease_trends"), "disease_trends"),
)
def model_checks(t: Tables) -> DataFrame:
    return q.run_checks(t.disease_trends, expectations.DISEASE_TRENDS)


@case(
    "dq_staging_checks",
    oracle(
        _checks_sql(expectations.STG_REV, "stg").replace("from stg", f"from ({STG_REV}) as stg"),
        "rev",
    ),
)
def staging_checks(t: Tables) -> DataFrame:
    return q.run_checks(m.stg_rev(t.rev), expectations.STG_REV)


def _fresh_sql(source: str, moment: str, limits: tuple[dt.timedelta, dt.timedelta]) -> str:
    warn, error = (int(limit.total_seconds() // 3600) for limit in limits)
    older = f"max({moment}) < timestamp '2024-02-10 00:00:00' - interval"
    return f"""select '{source}' as source, max({moment}) as newest,
  case when {older} '{error}' hour then 'error' when {older} '{warn}' hour then 'warn' else 'pass' end as status from {source}"""


@case(
    "dq_source_freshness",
    oracle(
        _fresh_sql("rev", "loaded_at", expectations.REV_FRESHNESS)
        + " union all "
        + _fresh_sql("patient_data", "recorded_at", expectations.PATIENT_FRESHNESS),
        "rev",
        "patient_data",
    ),
)
def source_freshness(t: Tables) -> DataFrame:
    rev = q.freshness(t.rev, "loaded_at", *expectations.REV_FRESHNESS, AS_OF)
    patients = q.freshness(t.patient_data, "recorded_at", *expectations.PATIENT_FRESHNESS, AS_OF)
    return rev.select(F.lit("rev").alias("source"), "*").union(patients.select(F.lit("patient_data"), "*"))
