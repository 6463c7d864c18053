"""The reference's input tables, derived from the given star schema.

Each property reads only given tables, so its size follows theirs.
``ORACLE_VIEWS`` holds the same definitions as SQL for the cross-check.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

AS_OF = dt.datetime(2024, 2, 10)

_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


class Tables:
    """Given tables of one scale folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        """A given table; its schema is inferred once per session, not once per query."""
        path = self.path(name)
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def register(self) -> None:
        """Temporary views of the record tables, for statements given as text."""
        for name in ("rev", "patient_data", "disease_trends"):
            getattr(self, name).createOrReplaceTempView(name)

    @cached_property
    def region(self) -> DataFrame:
        return self.read("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.read("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def rev(self) -> DataFrame:
        """Patient records with padded and mixed-case text, nulls and unknown outcomes."""
        key = F.col("o_orderkey")
        segment = F.col("c_mktsegment")
        priority = F.col("o_orderpriority")
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("row_key"),
            F.when(key % 2 == 0, F.concat(F.lit("  "), F.lower(segment), F.lit(" ")))
            .otherwise(segment)
            .alias("disease"),
            _either(key % 4 < 2, "Yes", " no").alias("fever"),
            _either(key % 3 == 0, "YES", "No").alias("cough"),
            _either(key % 5 < 2, "Yes", "No").alias("fatigue"),
            _either(key % 7 == 0, "yes ", "No").alias("difficulty_breathing"),
            F.when(key % 97 != 0, (F.col("o_custkey") % 121).cast("int")).alias("age"),
            _either(F.col("o_custkey") % 2 == 0, "Female", "Male").alias("gender"),
            F.when(F.col("o_orderstatus") == "F", "High")
            .when(F.col("o_orderstatus") == "O", "Low")
            .otherwise("Normal")
            .alias("blood_pressure"),
            F.when(key % 3 == 0, "High")
            .when(key % 3 == 1, "Low")
            .otherwise("Normal")
            .alias("cholesterol_level"),
            F.when(key % 89 == 0, None)
            .when(priority.isin("1-URGENT", "2-HIGH"), "Positive")
            .when(priority == "5-LOW", "Unknown")
            .otherwise("Negative")
            .alias("outcome_variable"),
            F.col("o_orderdate").alias("loaded_at"),
        )

    @cached_property
    def patient_data(self) -> DataFrame:
        """Patient events with JSON symptoms and demographics."""
        key, kind = F.col("event_id"), F.col("event_type")
        age = (18 + F.col("user_id") % 62).cast("string")
        return self.events.select(
            F.concat(F.lit("P"), F.lpad(key.cast("string"), 12, "0")).alias("patient_id"),
            F.when(kind == "click", "Automobile")
            .when(kind == "view", "Building")
            .when(kind == "purchase", "Furniture")
            .when(kind == "signup", "household")
            .otherwise("Unlisted")
            .alias("disease"),
            F.concat(
                F.lit('{"fever":'),
                _either(key % 2 == 0, "true", "false"),
                F.lit(',"cough":'),
                _either(key % 3 == 0, "true", "false"),
                F.lit("}"),
            ).alias("symptoms"),
            F.when(key % 50 == 0, '{"gender":"Male"}')
            .otherwise(F.concat(F.lit('{"age":'), age, F.lit(',"gender":"Female"}')))
            .alias("demographics"),
            _either(F.col("value") >= 20, "Positive", "Negative").alias("outcome"),
            F.col("ts").alias("recorded_at"),
        )

    @cached_property
    def disease_trends(self) -> DataFrame:
        """Daily cases and severity by disease type and region."""
        cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
        day = F.date_trunc("day", "ts").cast("date")
        return (
            self.events.join(self.region, F.col("user_id") % 5 == F.col("r_regionkey"))
            .groupBy(
                day.alias("trend_date"),
                F.col("event_type").alias("disease_type"),
                F.col("r_name").alias("region"),
            )
            .agg(
                F.count(F.lit(1)).cast("int").alias("case_count"),
                (cents.cast("double") / 100 / F.count(F.lit(1))).alias("severity_avg"),
            )
        )

    @cached_property
    def query_log(self) -> DataFrame:
        """One executed statement per event, with its text, tenant and cost."""
        key, kind = F.col("event_id"), F.col("event_type")
        text = F.lit(None).cast("string")
        for number, template in enumerate(QUERY_TEXTS):
            before, _, after = template.partition("{n}")
            number_text = (F.col("user_id") % 20).cast("string")
            filled = F.concat(F.lit(before), number_text, F.lit(after)) if "{n}" in template else F.lit(template)
            text = F.when(key % len(QUERY_TEXTS) == number, filled).otherwise(text)
        return self.events.select(
            key.alias("query_id"),
            F.concat(F.lit("tenant_"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
            text.alias("query"),
            _either(key % 6 == 5, "trino", "duckdb").alias("engine"),
            F.round(F.col("value") * 100).cast("bigint").alias("row_count"),
            F.round(F.col("value") * 1000).cast("bigint").alias("latency_us"),
            kind.isin("purchase", "click").alias("bill"),
            F.when(kind == "error", "FAILED")
            .when(kind == "view", "RUNNING")
            .otherwise("FINISHED")
            .alias("state"),
            F.col("ts").alias("created"),
        )

    @cached_property
    def table_registry(self) -> DataFrame:
        """Known tables with their store and true row counts; one lake table lacks statistics."""
        parts = []
        for name, store in REGISTERED_TABLES:
            counted = getattr(self, name).agg(F.count(F.lit(1)).alias("row_count"))
            parts.append(
                counted.select(
                    F.lit(name).alias("table_name"), F.lit(store).alias("source"), "row_count"
                )
            )
        unknown = F.when(F.col("table_name") != "lineitem", F.col("row_count"))
        registry = parts[0]
        for part in parts[1:]:
            registry = registry.union(part)
        return registry.withColumn("row_count", unknown)

    @cached_property
    def tenant_updates(self) -> DataFrame:
        """Config settings sent by tenants over time."""
        return self.events.select(
            F.concat(F.lit("tenant_"), (F.col("user_id") % 100).cast("string")).alias("tenant_id"),
            F.col("event_type").alias("config_key"),
            F.get_json_object("props", "$.k").alias("config_value"),
            F.col("ts").alias("updated_at"),
            F.col("event_id").alias("update_id"),
        )


# Tables of the small and the large store.
REGISTERED_TABLES = [
    ("customer", "duckdb"),
    ("events", "duckdb"),
    ("orders", "duckdb"),
    ("lineitem", "iceberg"),
]

# Statement texts of the log; {n} becomes a number.
QUERY_TEXTS = [
    "SELECT * FROM customer",
    "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "SELECT event_type, COUNT(*) FROM events GROUP BY event_type",
    "SELECT c_mktsegment, COUNT(*), AVG(o_totalprice) FROM orders o "
    "JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment",
    "SELECT event_type, COUNT(*) OVER (PARTITION BY event_type) FROM events "
    "WHERE user_id IN (SELECT c_custkey FROM customer)",
    "SELECT COUNT(*) FROM lineitem",
    "WITH recent AS (SELECT * FROM stage_{n}) SELECT MAX(v) FROM recent",
    "INSERT INTO events SELECT * FROM stage_{n}",
    "update customer SET c_acctbal = {n}",
    "  DELETE FROM orders WHERE o_custkey = {n}",
    "CREATE TABLE copy_{n} AS SELECT * FROM customer a JOIN orders b ON a.c_custkey = b.o_custkey "
    "JOIN events e ON e.user_id = a.c_custkey JOIN nation n ON n.n_nationkey = a.c_nationkey",
]


def _either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def _query_case() -> str:
    arms = []
    for number, template in enumerate(QUERY_TEXTS):
        before, mark, after = template.partition("{n}")
        text = f"'{before}'"
        if mark:
            text = f"concat('{before}', cast(user_id % 20 as varchar), '{after}')"
        arms.append(f"when event_id % {len(QUERY_TEXTS)} = {number} then {text}")
    return "case " + " ".join(arms) + " end"


ORACLE_VIEWS = {
    "rev": """
select o_orderkey as row_key,
  case when o_orderkey % 2 = 0 then concat('  ', lower(c_mktsegment), ' ') else c_mktsegment end as disease,
  case when o_orderkey % 4 < 2 then 'Yes' else ' no' end as fever,
  case when o_orderkey % 3 = 0 then 'YES' else 'No' end as cough,
  case when o_orderkey % 5 < 2 then 'Yes' else 'No' end as fatigue,
  case when o_orderkey % 7 = 0 then 'yes ' else 'No' end as difficulty_breathing,
  case when o_orderkey % 97 = 0 then null else cast(o_custkey % 121 as int) end as age,
  case when o_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
  case o_orderstatus when 'F' then 'High' when 'O' then 'Low' else 'Normal' end as blood_pressure,
  case when o_orderkey % 3 = 0 then 'High' when o_orderkey % 3 = 1 then 'Low' else 'Normal' end as cholesterol_level,
  case when o_orderkey % 89 = 0 then null
       when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Positive'
       when o_orderpriority = '5-LOW' then 'Unknown' else 'Negative' end as outcome_variable,
  o_orderdate as loaded_at
from orders join customer on o_custkey = c_custkey""",
    "patient_data": """
select concat('P', lpad(cast(event_id as varchar), 12, '0')) as patient_id,
  case event_type when 'click' then 'Automobile' when 'view' then 'Building'
                  when 'purchase' then 'Furniture' when 'signup' then 'household' else 'Unlisted' end as disease,
  concat('{"fever":', case when event_id % 2 = 0 then 'true' else 'false' end,
         ',"cough":', case when event_id % 3 = 0 then 'true' else 'false' end, '}') as symptoms,
  case when event_id % 50 = 0 then '{"gender":"Male"}'
       else concat('{"age":', cast(18 + user_id % 62 as varchar), ',"gender":"Female"}') end as demographics,
  case when value >= 20 then 'Positive' else 'Negative' end as outcome,
  ts as recorded_at
from events""",
    "disease_trends": """
select cast(date_trunc('day', ts) as date) as trend_date, event_type as disease_type,
  cast(count(*) as int) as case_count, r_name as region,
  cast(sum(cast(round(value * 100) as bigint)) as double) / 100 / count(*) as severity_avg
from events join region on user_id % 5 = r_regionkey
group by cast(date_trunc('day', ts) as date), event_type, r_name""",
    "query_log": f"""
select event_id as query_id, concat('tenant_', cast(user_id % 4 as varchar)) as tenant_id,
  {_query_case()} as query,
  case when event_id % 6 = 5 then 'trino' else 'duckdb' end as engine,
  cast(round(value * 100) as bigint) as row_count,
  cast(round(value * 1000) as bigint) as latency_us,
  event_type in ('purchase', 'click') as bill,
  case event_type when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'FINISHED' end as state,
  ts as created
from events""",
    "table_registry": """
select 'customer' as table_name, 'duckdb' as source, count(*) as row_count from customer
union all select 'events', 'duckdb', count(*) from events
union all select 'orders', 'duckdb', count(*) from orders
union all select 'lineitem', 'iceberg', case when count(*) >= 0 then null end from lineitem""",
    "tenant_updates": """
select concat('tenant_', cast(user_id % 100 as varchar)) as tenant_id, event_type as config_key,
  json_extract_string(props, '$.k') as config_value, ts as updated_at, event_id as update_id
from events""",
}


def oracle(body: str, *views: str) -> str:
    """The body with the named fixture views in front of it."""
    if not views:
        return body
    parts = [f"{name} as ({ORACLE_VIEWS[name]})" for name in views]
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
