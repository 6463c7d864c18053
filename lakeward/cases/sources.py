"""Sources: what is read back must be the given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.support import namespace
from lakeward.operators import catalog
from lakeward.plans.fixtures import AS_OF, Tables, oracle
from lakeward.session import fresh_path
from lakeward.sources import files, generated, tables as src

# Text columns with missing-value tokens in place of some values.
WITH_TOKENS = """select c_custkey, c_name, case when c_acctbal < 0 then 'NA' when c_acctbal < 1000 then 'null'
  when c_acctbal < 2000 then '' else cast(c_nationkey as varchar) end as nation_text, c_mktsegment from customer"""


def _customers_with_tokens(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    nation = (
        F.when(balance < 0, "NA")
        .when(balance < 1000, "null")
        .when(balance < 2000, "")
        .otherwise(F.col("c_nationkey").cast("string"))
    )
    return t.customer.select("c_custkey", "c_name", nation.alias("nation_text"), "c_mktsegment")


def _as_csv(df: DataFrame, separator: str = ",", header: bool = True, encoding: str = "utf-8") -> str:
    path = fresh_path(df.sparkSession, "csv")
    df.write.csv(path, sep=separator, header=header, encoding=encoding, quote='"', escape='"')
    return path


@case(
    "src_csv",
    f"""select c_custkey, c_name, cast(case when nation_text in ('', 'NA', 'null') then null else nation_text end as bigint) as nation_text,
  c_mktsegment from ({WITH_TOKENS})""",
)
def csv(t: Tables) -> DataFrame:
    path = _as_csv(_customers_with_tokens(t), separator=";")
    return files.read_csv(t.spark, path, separator=";")


@case(
    "src_csv_declared",
    f"""select c_custkey as id, c_name as name, cast(case when nation_text in ('', 'NA', 'null') then null else nation_text end as integer) as nation,
  c_mktsegment as segment from ({WITH_TOKENS})""",
)
def csv_declared(t: Tables) -> DataFrame:
    path = _as_csv(_customers_with_tokens(t), header=False, encoding="iso-8859-1")
    return files.read_csv(
        t.spark,
        path,
        schema="id bigint, name string, nation int, segment string",
        header=False,
        encoding="iso-8859-1",
    )


@case(
    "src_csv_schema",
    """select 1::bigint as position, 'c_custkey' as column_name, 'bigint' as data_type, count(c_custkey) as filled from customer
union all select 2, 'c_name', 'string', count(c_name) from customer
union all select 3, 'nation_text', 'bigint', count(case when c_acctbal >= 2000 then 1 end) from customer
union all select 4, 'c_mktsegment', 'string', count(c_mktsegment) from customer""",
)
def csv_schema(t: Tables) -> DataFrame:
    path = _as_csv(_customers_with_tokens(t))
    found = files.csv_schema(t.spark, path)
    known = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    report = files.schema_report(files.read_csv(t.spark, path))
    return report.withColumn("data_type", F.element_at(known, F.col("column_name")))


@case("src_csv_arrow", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_inferred(t: Tables) -> DataFrame:
    path = _as_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    # Spark infers the narrowest integer; keep the keys wide.
    read = files.read_csv_inferred(t.spark, path)
    return read.withColumns({n: F.col(n).cast("bigint") for n in ["o_orderkey", "o_custkey"]})


@case("src_parquet", "select l_orderkey, l_linenumber, l_extendedprice from lineitem")
def parquet(t: Tables) -> DataFrame:
    return files.read_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


@case(
    "src_parquet_schema",
    """select 1::bigint as position, 'event_id' as column_name, 'bigint' as data_type, count(event_id) as filled from events
union all select 2, 'ts', 'timestamp_ntz', count(ts) from events
union all select 3, 'user_id', 'bigint', count(user_id) from events
union all select 4, 'event_type', 'string', count(event_type) from events
union all select 5, 'value', 'double', count(value) from events
union all select 6, 'props', 'string', count(props) from events""",
)
def parquet_schema(t: Tables) -> DataFrame:
    return files.schema_report(files.read_parquet(t.spark, t.path("events")))


@case(
    "src_check",
    """select 'orders' as source, true as readable, count(*) as rows from orders
union all select 'events', true, count(*) from events""",
)
def check(t: Tables) -> DataFrame:
    checked = {name: files.check_source(t.spark, t.path(name), "parquet") for name in ["orders", "events"]}
    overview = catalog.dataset_overview({name: t.read(name) for name, (ok, _) in checked.items() if ok})
    readable = F.col("name").isin([name for name, (ok, _) in checked.items() if ok])
    return overview.select(F.col("name").alias("source"), readable.alias("readable"), "rows")


@case(
    "src_table",
    "select o_orderstatus, count(*) as n from orders where o_totalprice > 1000.5 group by o_orderstatus",
)
def table(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.spark.catalog.createTable(f"{ns}.orders", path=t.path("orders"), source="parquet")
    return src.scan(
        t.spark,
        f"{ns}.orders",
        query=f"select o_orderstatus, count(*) as n from {ns}.orders where o_totalprice > :least group by o_orderstatus",
        args={"least": 1000.5},
    )


@case("src_table_sample", "select p_partkey, p_name, p_size from part order by p_size desc, p_partkey limit 25")
def table_sample(t: Tables) -> DataFrame:
    order = [F.col("p_size").desc_nulls_last(), F.col("p_partkey").asc_nulls_last()]
    return src.sample(t.part.select("p_partkey", "p_name", "p_size"), 25, *order)


@case(
    "src_views",
    """select 'customer' as name, count(*) as rows, 5::bigint as columns from customer
union all select 'order_lines', count(*), 11 from lineitem union all select 'orders', count(*), 6 from orders""",
)
def views(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    for name, table_name in {"customer": "customer", "order_lines": "lineitem", "orders": "orders"}.items():
        where = f"{ns}.{src.quoted(name)}"
        t.spark.sql(f"CREATE TABLE {where} USING parquet LOCATION '{t.path(table_name)}'")
    names = src.reflect_views(t.spark, ns, prefix=f"{ns}_")
    found = {n.removeprefix(f"{ns}_"): t.spark.table(src.quoted(n)) for n in names}
    return catalog.dataset_overview(found)


@case("src_seed", "select n_nationkey, n_name, count(*) as customers from nation join customer on c_nationkey = n_nationkey group by n_nationkey, n_name")
def seed(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    path = _as_csv(t.nation.select("n_nationkey", "n_name"))
    nations = src.seed(t.spark, path, "n_nationkey int, n_name string", f"{ns}.nations")
    joined = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("customers"))


VALUES = [(name, number) for number, name in enumerate(
    ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNLISTED"], start=1
)]


@case(
    "src_values",
    oracle(
        """with codes as (select * from (values ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 3), ('HOUSEHOLD', 4),
  ('MACHINERY', 5), ('UNLISTED', 6)) as t(disease_name, code))
select patient_id, code from patient_data join codes on upper(disease) = disease_name""",
        "patient_data",
    ),
)
def values(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.spark.sql(f"CREATE TABLE {ns}.codes (disease_name STRING, code INT) USING parquet")
    generated.insert_values(t.spark, f"{ns}.codes", VALUES, "disease_name string, code int", batch=4)
    codes = t.spark.table(f"{ns}.codes")
    return t.patient_data.join(codes, F.upper("disease") == F.col("disease_name")).select("patient_id", "code")


@case(
    "src_series",
    """select 'P' || o_orderkey as patient_id, (['Flu', 'Cold', 'Headache', 'Allergy'])[1 + (o_orderkey % 4)] as disease,
  20 + (o_orderkey % 50) as age, (['Male', 'Female'])[1 + (o_orderkey % 2)] as gender,
  (['Positive', 'Negative'])[1 + (o_orderkey % 2)] as outcome from orders""",
)
def series(t: Tables) -> DataFrame:
    return generated.local_patients(t.orders.select(F.col("o_orderkey").alias("id")))


def _draw(what: str, below: int) -> str:
    return f"(('0x' || substr(md5(concat(c_custkey, ':42:{what}')), 1, 8))::bigint % {below})"


@case(
    "src_random",
    f"""select 'P' || lpad(cast(c_custkey as varchar), 12, '0') as patient_id,
  (['COVID-19', 'Influenza', 'Pneumonia', 'Bronchitis', 'Asthma'])[1 + {_draw('disease', 5)}] as disease,
  concat('{{"fever":', case when {_draw('fever', 2)} = 1 then 'true' else 'false' end,
    ',"cough":', case when {_draw('cough', 2)} = 1 then 'true' else 'false' end,
    ',"fatigue":', case when {_draw('fatigue', 2)} = 1 then 'true' else 'false' end,
    ',"breathing_difficulty":', case when {_draw('breathing_difficulty', 2)} = 1 then 'true' else 'false' end, '}}') as symptoms,
  concat('{{"age":', 18 + {_draw('age', 62)}, ',"gender":"', (['Male', 'Female'])[1 + {_draw('gender', 2)}],
    '","location":"', (['Urban', 'Rural'])[1 + {_draw('location', 2)}], '"}}') as demographics,
  (['Positive', 'Negative'])[1 + {_draw('outcome', 2)}] as outcome,
  timestamp '2024-02-10 00:00:00' - to_days(cast({_draw('day', 30)} as integer)) as recorded_at
from customer""",
)
def random(t: Tables) -> DataFrame:
    numbers = t.customer.select(F.col("c_custkey").alias("id"))
    return generated.sample_patients(numbers, 42, AS_OF)


@case(
    "ord_empty",
    """select 1::bigint as position, 'o_orderstatus' as column_name, 'string' as data_type, count(distinct o_orderstatus) as filled from orders
union all select 2, 'total', 'double', count(distinct o_orderstatus) from orders""",
)
def empty(t: Tables) -> DataFrame:
    path = src.quoted(t.path("orders"))
    query = f"select o_orderstatus, max(o_totalprice) as total from parquet.{path} group by o_orderstatus"
    schema = src.schema_of(t.spark, query)
    report = files.schema_report(t.spark.sql(query))
    declared = {f.name: f.dataType.simpleString() for f in schema.fields}
    known = F.create_map(*[F.lit(x) for pair in declared.items() for x in pair])
    return report.filter(F.element_at(known, F.col("column_name")) == F.col("data_type"))


