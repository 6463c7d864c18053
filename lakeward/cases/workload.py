"""Classification of logged statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.cases import case
from lakeward.operators import workload
from lakeward.plans.fixtures import Tables, oracle

FEATURES = r"""
used as (select query_id, query, lower(query) as q, regexp_extract_all(lower(query), '\b(?:from|join)\s+([a-z_][a-z0-9_]*)', 1) as tables
  from query_log),
flags as (select query_id, query, tables, cast(len(list_distinct(tables)) as bigint) as table_count,
  regexp_matches(q, '\bjoin\b') as has_join,
  contains(q, 'group by') or contains(q, 'having') or contains(q, 'count(') or contains(q, 'sum(')
    or contains(q, 'avg(') or contains(q, 'max(') or contains(q, 'min(') as has_aggregation,
  regexp_matches(q, '\(\s*select\b') as has_subquery,
  regexp_matches(q, '\bwindow\b|\bover\s*\(') as has_window,
  regexp_matches(q, '\brecursive\b|\bwith\b') as has_cte from used),
scored as (select *, cast(table_count as double) + case when has_join then 2e0 else 0e0 end
  + case when has_aggregation then 15e-1 else 0e0 end + case when has_subquery then 2e0 else 0e0 end
  + case when has_window then 2e0 else 0e0 end + case when has_cte then 15e-1 else 0e0 end as score from flags),
classed as (select *, case when has_aggregation and table_count > 1 then 'analytical' when has_join then 'join'
  when has_aggregation then 'aggregation' when score > 3 then 'complex' else 'simple_select' end as query_class from scored)"""


@case(
    "wl_features",
    oracle(
        f"""with {FEATURES}
select query_id, array_to_string(tables, ',') as tables, table_count, has_join, has_aggregation, has_subquery, has_window, has_cte,
  score, query_class from classed""",
        "query_log",
    ),
)
def features(t: Tables) -> DataFrame:
    found = workload.features(t.query_log)
    return found.select(
        "query_id",
        F.array_join("tables_used", ",").alias("tables"),
        "table_count",
        "has_join",
        "has_aggregation",
        "has_subquery",
        "has_window",
        "has_cte",
        "score",
        "query_class",
    )


@case(
    "wl_score2",
    oracle(
        r"""select query_id, cast(2 * len(regexp_extract_all(upper(query), '\bJOIN\b')) + len(regexp_extract_all(upper(query), '\bSELECT\b')) - 1
  + 2 * len(regexp_extract_all(upper(query), '\bOVER\s*\(')) + len(regexp_extract_all(upper(query), '\bGROUP BY\b'))
  + len(regexp_extract_all(upper(query), '\bWITH\b')) as bigint) as score from query_log""",
        "query_log",
    ),
)
def score(t: Tables) -> DataFrame:
    return t.query_log.select("query_id", workload.second_score(F.col("query")).alias("score"))


@case(
    "wl_type",
    oracle(
        """select query_id, case when upper(ltrim(query)) like 'INSERT%' then 'insert' when upper(ltrim(query)) like 'UPDATE%' then 'update'
  when upper(ltrim(query)) like 'DELETE%' then 'delete' when upper(ltrim(query)) like 'CREATE%' then 'create'
  when upper(ltrim(query)) like 'DROP%' then 'drop' when upper(ltrim(query)) like 'ALTER%' then 'alter' else 'select' end as kind
from query_log""",
        "query_log",
    ),
)
def kind(t: Tables) -> DataFrame:
    return t.query_log.select("query_id", workload.statement_type(F.col("query")).alias("kind"))


SIZES = """
named as (select query_id, unnest(tables) as table_name from used),
sized as (select query_id, named.table_name, source,
  cast(coalesce(row_count, case when source = 'iceberg' then 10000000 end, 100000) as bigint) as expected_rows
  from named left join table_registry on named.table_name = table_registry.table_name)"""


@case(
    "join_registry",
    oracle(f"with {FEATURES},{SIZES}\nselect * from sized", "query_log", "table_registry"),
)
def registry(t: Tables) -> DataFrame:
    return workload.registered_sizes(t.query_log, t.table_registry, "query_id")


@case(
    "wl_route",
    oracle(
        f"""with {FEATURES},{SIZES},
totals as (select query_id, cast(sum(expected_rows) as bigint) as total, bool_or(coalesce(source = 'iceberg', false)) as lake
  from sized group by query_id),
joined as (select c.query_id, score, table_count, query_class, coalesce(total, 0) as expected_rows, coalesce(lake, false) as lake
  from classed c left join totals using (query_id))
select query_id, score, query_class, expected_rows,
  concat_ws(',', case when lake then 'lake table' end, case when expected_rows > 1000000 then 'rows' end,
    case when score > 5 then 'score' end, case when table_count > 3 then 'tables' end,
    case when query_class = 'analytical' and expected_rows > 100000 then 'analytical' end) as reasons,
  case when lake or expected_rows > 1000000 or score > 5 or table_count > 3
    or (query_class = 'analytical' and expected_rows > 100000) then 'large' else 'small' end as target
from joined""",
        "query_log",
        "table_registry",
    ),
)
def route(t: Tables) -> DataFrame:
    return workload.route(t.query_log, t.table_registry, "query_id")
