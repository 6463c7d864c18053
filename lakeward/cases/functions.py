"""Scalar functions (one query each)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.functions import columns as c
from lakeward.plans.fixtures import AS_OF, Tables, oracle


@case("fn_trim_upper", oracle("select row_key, trim(disease) as trimmed, upper(disease) as upper_text from rev", "rev"))
def trim_upper(t: Tables) -> DataFrame:
    return t.rev.select("row_key", F.trim("disease").alias("trimmed"), F.upper("disease").alias("upper_text"))


@case(
    "fn_concat",
    oracle(
        """select row_key, gender || ':' || outcome_variable as joined, concat(gender, ':', outcome_variable) as skipping from rev""",
        "rev",
    ),
)
def concat(t: Tables) -> DataFrame:
    parts = [F.col("gender"), F.lit(":"), F.col("outcome_variable")]
    return t.rev.select(
        "row_key", F.concat(*parts).alias("joined"), c.concat_skip_nulls(*parts).alias("skipping")
    )


@case("fn_length", "select doc_id, cast(length(text) as bigint) as characters from documents")
def length(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.length("text").cast("bigint").alias("characters"))


@case(
    "fn_substring",
    "select p_partkey, substring(p_name, 1, 3) as head, substring(p_name, 4, 100) as tail from part",
)
def substring(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.substring("p_name", 1, 3).alias("head"), F.substring("p_name", 4, 100).alias("tail")
    )


@case(
    "fn_round_ceil_floor",
    """select o_orderkey, round(o_totalprice, 1) as rounded, cast(ceil(o_totalprice) as bigint) as above,
  cast(floor(o_totalprice) as bigint) as below from orders""",
)
def round_ceil_floor(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.round(price, 1).alias("rounded"),
        F.ceil(price).cast("bigint").alias("above"),
        F.floor(price).cast("bigint").alias("below"),
    )


@case(
    "fn_modulo",
    "select event_id, event_id % 7 as remainder, 20 + user_id % 50 as age, event_id // 10 as tens from events",
)
def modulo(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        (F.col("event_id") % 7).alias("remainder"),
        (20 + F.col("user_id") % 50).alias("age"),
        F.expr("event_id div 10").alias("tens"),
    )


@case(
    "fn_current",
    """select event_id, timestamp '2024-02-10 00:00:00' as now, date '2024-02-10' as today,
  date_diff('day', cast(ts as date), date '2024-02-10') as age_days from events""",
)
def current(t: Tables) -> DataFrame:
    now = c.moment(AS_OF)
    return t.events.select(
        "event_id",
        now.alias("now"),
        now.cast("date").alias("today"),
        F.date_diff(now.cast("date"), F.col("ts").cast("date")).cast("bigint").alias("age_days"),
    )


@case(
    "fn_date_trunc",
    """select event_id, date_trunc('hour', ts) as hour, date_trunc('day', ts) as day,
  cast(date_trunc('month', ts) as timestamp) as month from events""",
)
def date_trunc(t: Tables) -> DataFrame:
    units = ["hour", "day", "month"]
    return t.events.select("event_id", *[c.trunc_to(u, "ts", t.events).alias(u) for u in units])


@case(
    "fn_extract",
    """select event_id, cast(extract(year from ts) as bigint) as y, cast(extract(month from ts) as bigint) as mon,
  cast(extract(day from ts) as bigint) as d, cast(extract(hour from ts) as bigint) as h,
  cast(extract(dow from ts) as bigint) as dow, cast(extract(doy from ts) as bigint) as doy,
  cast(extract(quarter from ts) as bigint) as q, cast(extract(week from ts) as bigint) as w from events""",
)
def extract(t: Tables) -> DataFrame:
    def part(field: str) -> F.Column:
        return F.expr(f"extract({field} from ts)").cast("bigint")

    fields = {"y": "year", "mon": "month", "d": "day", "h": "hour", "doy": "doy", "q": "quarter", "w": "week"}
    return t.events.select(
        "event_id", *[part(f).alias(name) for name, f in fields.items()], c.day_of_week("ts").alias("dow")
    )


@case(
    "fn_interval",
    """select o_orderkey, o_orderdate - interval '30' day as month_before, o_orderdate + interval '6' hour as later from orders""",
)
def interval(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        (date - F.expr("INTERVAL 30 DAYS")).alias("month_before"),
        (date + F.lit(dt.timedelta(hours=6))).alias("later"),
    )


@case(
    "fn_case",
    """select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as status,
  case when o_totalprice > 300000 then 'big' when o_totalprice > 100000 then 'middle' end as size from orders""",
)
def case_when(t: Tables) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(status == "F", "done").when(status == "O", "open").otherwise("other").alias("status"),
        F.when(price > 300000, "big").when(price > 100000, "middle").alias("size"),
    )


@case(
    "fn_cast",
    """select event_id, cast(value as varchar) as value_text, cast(json_extract_string(props, '$.k') as integer) as k,
  try_cast(event_type as integer) as no_number, cast(ts as date) as day, cast(event_id as double) as id_double from events""",
)
def cast(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.col("value").cast("string").alias("value_text"),
        c.json_value("props", "k", "int").alias("k"),
        c.lenient_bigint("event_type").try_cast("int").alias("no_number"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_id").cast("double").alias("id_double"),
    )


@case(
    "fn_json_object",
    oracle(
        """select row_key, '{"age":' || coalesce(cast(age as varchar), 'null') || ',"gender":"' || gender || '","outcome":'
  || coalesce('"' || outcome_variable || '"', 'null') || '}' as person from rev""",
        "rev",
    ),
)
def json_object(t: Tables) -> DataFrame:
    person = {"age": F.col("age"), "gender": F.col("gender"), "outcome": F.col("outcome_variable")}
    return t.rev.select("row_key", c.json_object(person).alias("person"))


@case(
    "fn_json_extract",
    oracle(
        """select patient_id, json_extract_string(demographics, '$.gender') as gender,
  cast(json_extract_string(demographics, '$.age') as integer) as age,
  json_extract_string(symptoms, '$.fever') as fever from patient_data""",
        "patient_data",
    ),
)
def json_extract(t: Tables) -> DataFrame:
    return t.patient_data.select(
        "patient_id",
        c.json_value("demographics", "gender").alias("gender"),
        c.json_value("demographics", "age", "int").alias("age"),
        c.json_value("symptoms", "fever").alias("fever"),
    )


@case(
    "fn_cardinality",
    """select conv_id, turn, cast(len(string_split(text, ' ')) as bigint) as words from conversations""",
)
def cardinality(t: Tables) -> DataFrame:
    words = F.split("text", " ", -1)
    return t.read("conversations").select("conv_id", "turn", F.cardinality(words).cast("bigint").alias("words"))


@case(
    "fn_array_pick",
    """select event_id, (['Flu', 'Cold', 'Headache', 'Allergy'])[1 + (event_id % 4)] as disease,
  (['Male', 'Female'])[1 + (user_id % 2)] as gender from events""",
)
def array_pick(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        c.pick(["Flu", "Cold", "Headache", "Allergy"], F.col("event_id")).alias("disease"),
        c.pick(["Male", "Female"], F.col("user_id")).alias("gender"),
    )


@case(
    "fn_map_merge",
    """select c_custkey, c_mktsegment as tier, 'customer' as kind, cast(c_nationkey as varchar) as region, 3::bigint as members from customer""",
)
def map_merge(t: Tables) -> DataFrame:
    older = F.create_map(F.lit("tier"), F.lit("none"), F.lit("kind"), F.lit("customer"))
    newer = F.create_map(
        F.lit("tier"), F.col("c_mktsegment"), F.lit("region"), F.col("c_nationkey").cast("string")
    )
    merged = t.customer.withColumn("config", c.merge_maps(older, newer))
    return merged.select(
        "c_custkey",
        F.element_at("config", "tier").alias("tier"),
        F.element_at("config", "kind").alias("kind"),
        F.element_at("config", "region").alias("region"),
        F.size("config").cast("bigint").alias("members"),
    )
