"""Catalog listings, statistics and the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.cases.support import namespace
from lakeward.operators import catalog, maintenance, sinks, statistics
from lakeward.plans.fixtures import AS_OF, Tables, oracle
from lakeward.session import fresh_path
from lakeward.sources import files


@case(
    "meta_list",
    """select 'lake.lineitem' as name, count(*) as rows, 11::bigint as columns from lineitem
union all select 'local.customer', count(*), 5 from customer union all select 'local.orders', count(*), 6 from orders""",
)
def listing(t: Tables) -> DataFrame:
    stores = {"local": namespace(t.spark), "lake": namespace(t.spark)}
    for store, name in [("local", "orders"), ("local", "customer"), ("lake", "lineitem")]:
        t.spark.sql(f"CREATE TABLE {stores[store]}.{name} USING parquet LOCATION '{t.path(name)}'")
    names = catalog.list_tables(t.spark, stores)
    frames = {}
    for name in names:
        store, table = name.split(".")
        frames[name] = t.spark.table(f"{stores[store]}.{table}")
    return catalog.dataset_overview(frames)


@case(
    "meta_describe",
    """select 1::bigint as position, 'c_custkey' as column_name, 'bigint' as data_type, count(c_custkey) as filled from customer
union all select 2, 'c_name', 'string', count(c_name) from customer
union all select 3, 'c_nationkey', 'int', count(c_nationkey) from customer
union all select 4, 'c_acctbal', 'double', count(c_acctbal) from customer
union all select 5, 'c_mktsegment', 'string', count(c_mktsegment) from customer""",
)
def description(t: Tables) -> DataFrame:
    ns = namespace(t.spark)
    t.spark.sql(f"CREATE TABLE {ns}.customer USING parquet LOCATION '{t.path('customer')}'")
    described = catalog.describe(t.spark, f"{ns}.customer")
    return described.join(
        catalog.schema_report(t.spark.table(f"{ns}.customer")), ["position", "column_name", "data_type"]
    )


def _stats_sql(name: str, table: str, ordered: bool) -> str:
    low = f"cast(min({name}) as varchar)" if ordered else "cast(null as varchar)"
    high = f"cast(max({name}) as varchar)" if ordered else "cast(null as varchar)"
    return f"""select '{name}' as column_name, cast(count(*) - count({name}) as double) / count(*) as null_share,
  count(distinct {name}) as distinct_values, {low} as low_value, {high} as high_value, cast(null as bigint) as row_count from {table}"""


@case(
    "meta_stats",
    oracle(
        " union all ".join(
            [
                _stats_sql("row_key", "rev", True),
                _stats_sql("disease", "rev", False),
                _stats_sql("age", "rev", True),
                _stats_sql("outcome_variable", "rev", False),
                _stats_sql("loaded_at", "rev", True),
                "select null, null, null, null, null, count(*) from rev",
            ]
        ),
        "rev",
    ),
)
def exact_statistics(t: Tables) -> DataFrame:
    columns = ["row_key", "disease", "age", "outcome_variable", "loaded_at"]
    return catalog.statistics(t.rev.select(columns), exact=True)


def _approx_sql(name: str, ordered: bool) -> str:
    exact = _stats_sql(name, "lineitem", ordered)
    return f"select column_name, null_share, true as close, low_value, high_value, row_count from ({exact})"


_LINEITEM = {
    "l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True,
    "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": True,
}
_APPROX = " union all ".join(
    [*(_approx_sql(n, o) for n, o in _LINEITEM.items()), "select null, null, true, null, null, count(*) from lineitem"]
)


def _judged(estimated: DataFrame, table: DataFrame, error: float) -> DataFrame:
    """Exact figures as they are; an estimated distinct count becomes whether it is within the error."""
    exact = catalog.statistics(table, exact=True).select(
        F.col("column_name").alias("c"), F.col("distinct_values").alias("d")
    )
    near = F.abs(F.col("distinct_values") - F.col("d")) <= F.greatest(F.lit(1), F.ceil(F.lit(error) * F.col("d")))
    return estimated.join(exact, F.col("column_name").eqNullSafe(F.col("c"))).select(
        "column_name", "null_share", F.when(F.col("column_name").isNull(), True).otherwise(near).alias("close"),
        "low_value", "high_value", "row_count",
    )


@case("meta_stats_approx", _APPROX)
def statistics_approximate(t: Tables) -> DataFrame:
    """Estimates of the whole table, within three standard errors (5 % each)."""
    return _judged(catalog.statistics(t.lineitem), t.lineitem, 3 * 0.05)


@case("meta_stats_loads", _APPROX)
def statistics_by_load(t: Tables) -> DataFrame:
    """Three loads, one of them repeated: each is read alone, the kept rows are merged."""
    path, schema = fresh_path(t.spark, "statistics"), t.lineitem.schema
    year = F.year("l_shipdate")
    for load in ("early", "middle", "late", "middle"):
        border = {"early": year < 1994, "middle": year.between(1994, 1996), "late": (year > 1996) | year.isNull()}
        statistics.record_load(t.lineitem.where(border[load]), path, load)
    return _judged(statistics.recorded(t.spark, path, schema), t.lineitem, statistics.ERROR)


@case(
    "meta_stats_partitions",
    oracle(
        """select tenant_id, count(*) as rows, count(latency_us) as measured, min(query_id) as low, max(query_id) as high
from query_log group by tenant_id union all select null, count(*), count(latency_us), min(query_id), max(query_id) from query_log""",
        "query_log",
    ),
)
def statistics_by_partition(t: Tables) -> DataFrame:
    """A row per partition of a table, and all of them merged."""
    path = fresh_path(t.spark, "statistics")
    log = t.query_log.select("query_id", "latency_us", "tenant_id")
    statistics.record_partitions(log, path, ["tenant_id"])
    kept = t.spark.read.parquet(path)
    each = kept.select("tenant_id", "rows", F.col("filled1").alias("measured"), F.col("low0").alias("low"), F.col("high0").alias("high"))
    whole = each.agg(*[f.alias(n) for n, f in zip(each.columns[1:], (F.sum("rows"), F.sum("measured"), F.min("low"), F.max("high")))])
    return each.unionByName(whole.withColumn("tenant_id", F.lit(None).cast("string")))


@case(
    "meta_partitions",
    oracle("select tenant_id, count(*) as rows, true as listed from query_log group by tenant_id", "query_log"),
)
def partitions(t: Tables) -> DataFrame:
    """Rows per partition, and whether its files and bytes are those that a listing shows."""
    path = fresh_path(t.spark, "by-tenant")
    sinks.write_partitioned(t.query_log.select("query_id", "row_count", "tenant_id"), path)
    listed = (
        files.file_sizes(t.spark, path)
        .groupBy(F.regexp_extract("path", "tenant_id=([^/]*)", 1).alias("tenant_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    )
    found = catalog.partitions(t.spark.read.parquet(path), ["tenant_id"]).join(listed, "tenant_id", "full")
    agree = F.coalesce((F.col("files") == F.col("n")) & (F.col("bytes") == F.col("size")), F.lit(False))
    return found.select("tenant_id", "rows", agree.alias("listed"))


@case(
    "meta_info",
    """select 'description' as part, 6::bigint as entries, cast(null as bigint) as rows from orders having count(*) > 0
union all select 'history', 1, count(*) from orders
union all select 'partitions', count(distinct o_orderstatus), count(*) from orders
union all select 'stats', 7, count(*) from orders""",
)
def info(t: Tables) -> DataFrame:
    table = f"{namespace(t.spark)}.orders"
    t.orders.write.partitionBy("o_orderstatus").saveAsTable(table)
    if catalog.table_info(t.spark, table)["history"] is not None:
        raise RuntimeError("a table without snapshots has no history")
    maintenance.snapshot(t.spark, table.split(".")[0], AS_OF)
    found = catalog.table_info(t.spark, table)
    rows = {"description": F.lit(None), "stats": F.max("row_count"), "partitions": F.sum("rows"), "history": F.sum("rows")}
    parts = [
        found[part].agg(
            F.lit(part).alias("part"),
            F.count(F.lit(1)).alias("entries"),
            rows[part].cast("bigint").alias("rows"),
        )
        for part in rows
    ]
    return reduce(DataFrame.union, parts)


@case(
    "meta_register",
    """select 'tenant_a' as tenant_id, 'orders' as name, 'small' as target, count(*) as rows, 6 as columns,
  timestamp '2024-02-10 00:00:00' as upload_time from orders
union all select 'tenant_b', 'lineitem', 'large', count(*), 11, timestamp '2024-02-10 00:00:00' from lineitem""",
)
def register(t: Tables) -> DataFrame:
    registry = f"{namespace(t.spark)}.datasets"
    for tenant, name, target in [("tenant_a", "orders", "small"), ("tenant_b", "lineitem", "large")]:
        df = t.read(name)
        catalog.register_dataset(t.spark, registry, tenant, name, target, df.count(), len(df.columns), AS_OF)
    return t.spark.table(registry)


@case(
    "meta_upsert",
    oracle(
        """select tenant_id, config_key, arg_max(config_value, update_id) as config_value, max(updated_at) as updated_at,
  arg_max(update_id, update_id) as update_id, min(updated_at) as created_at from (
  select *, row_number() over (partition by tenant_id, config_key order by updated_at, update_id) as n from tenant_updates)
group by tenant_id, config_key""",
        "tenant_updates",
    ),
)
def upsert(t: Tables) -> DataFrame:
    # Two loads: updates of the first half of the month, then the rest.
    early = F.col("updated_at") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    first = catalog.upsert_settings(None, t.tenant_updates.filter(early))
    return catalog.upsert_settings(first, t.tenant_updates.filter(~early))


@case(
    "meta_tenants",
    oracle(
        """with latest as (select tenant_id, config_key, config_value, updated_at from tenant_updates
  qualify row_number() over (partition by tenant_id, config_key order by updated_at desc, update_id desc) = 1)
select tenant_id, (n - 1) // 2 as page, string_agg(config_key || '=' || config_value, ',' order by config_key) as config,
  max(updated_at) as updated_at
from (select *, row_number() over (partition by tenant_id order by config_key) as n from latest) group by tenant_id, page""",
        "tenant_updates",
    ),
)
def tenants(t: Tables) -> DataFrame:
    table = catalog.tenant_table(catalog.upsert_settings(None, t.tenant_updates), page_size=2)
    pairs = F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table.select("tenant_id", "page", F.array_join(F.sort_array(pairs), ",").alias("config"), "updated_at")


@case(
    "meta_catalogs",
    """select concat('catalog_', user_id) as catalog_name, arg_max(event_type, event_id) as tenant_id, max(ts) as linked_at from (
  select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) group by user_id""",
)
def catalogs(t: Tables) -> DataFrame:
    links = t.events.select(
        F.concat(F.lit("catalog_"), F.col("user_id").cast("string")).alias("catalog_name"),
        F.col("event_type").alias("tenant_id"),
        F.col("ts").alias("linked_at"),
        F.col("event_id").alias("link_id"),
    )
    return catalog.catalog_index(links)


@case(
    "meta_overview",
    oracle(
        """with tenants as (
  select tenant_id, count(distinct config_key) as settings, 0 as datasets, 0 as catalogs, 0 as statements from tenant_updates group by 1
  union all select tenant_id, 0, 0, 0, count(*) from query_log group by 1
  union all select tenant_id, 0, 0, count(*), 0 from (
    select user_id, arg_max(concat('tenant_', event_type), event_id) as tenant_id from (
      select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) group by 1) group by 1
  union all select concat('tenant_', lower(o_orderstatus)), 0, count(distinct o_orderstatus), 0, 0 from orders group by 1)
select tenant_id, sum(settings)::bigint as settings, sum(datasets)::bigint as datasets, sum(catalogs)::bigint as catalogs,
  sum(statements)::bigint as statements from tenants group by tenant_id""",
        "tenant_updates",
        "query_log",
    ),
)
def overview(t: Tables) -> DataFrame:
    links = t.events.select(
        F.concat(F.lit("catalog_"), F.col("user_id").cast("string")).alias("catalog_name"),
        F.concat(F.lit("tenant_"), F.col("event_type")).alias("tenant_id"),
        F.col("ts").alias("linked_at"),
        F.col("event_id").alias("link_id"),
    )
    datasets = t.orders.select("o_orderstatus").distinct().select(F.concat(F.lit("tenant_"), F.lower("o_orderstatus")).alias("tenant_id"))
    settings = catalog.upsert_settings(None, t.tenant_updates)
    return catalog.tenant_overview(settings, datasets, links, t.query_log)
