from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import joins, metering, workload as w

# Statement, score, class.
STATEMENTS = [
    ("SELECT * FROM ward_list", 1.0, "simple_select"),
    ("SELECT w.bed, s.name FROM wards w JOIN staff s ON w.head = s.id", 4.0, "join"),
    ("SELECT ward, SUM(beds) FROM wards GROUP BY ward", 2.5, "aggregation"),
    (
        "SELECT w.ward, COUNT(*), MAX(v.cost) FROM wards w JOIN visits v ON v.ward = w.ward GROUP BY w.ward",
        5.5,
        "analytical",
    ),
]


@pytest.fixture(scope="module")
def statements(spark):
    data = [(i, text) for i, (text, _, _) in enumerate(STATEMENTS)]
    data += [
        (4, "SELECT ward,\n SUM(cost) OVER (PARTITION BY ward) FROM visits\n WHERE bed IN (SELECT bed FROM wards)"),
        (5, "SELECT COUNT(*) FROM patient_data"),
        (6, "SELECT 1"),
        (7, "SELECT * FROM a JOIN b ON 1=1 JOIN c ON 1=1 JOIN d ON 1=1"),
        (8, "SELECT withdrawn, overdue FROM known"),
    ]
    return spark.createDataFrame(data, "id int, query string")


@pytest.fixture(scope="module")
def registry(spark):
    data = [("patient_data", "iceberg", None), ("known", "duckdb", 2_000_000), ("wards", "duckdb", 50)]
    return spark.createDataFrame(data, "table_name string, source string, row_count long")


def test_scores_and_classes(statements):
    found = {r.id: r for r in w.features(statements).collect()}
    for i, (_, score, kind) in enumerate(STATEMENTS):
        assert (found[i].score, found[i].query_class) == (score, kind)
    assert found[4].has_subquery and found[4].has_window and found[4].score > 3
    assert not found[2].has_subquery  # count(*) is no subquery
    assert not (found[8].has_cte or found[8].has_window)  # words inside names


def test_second_score_and_types(statements, spark):
    scores = {r.id: r.s for r in statements.select("id", w.second_score(F.col("query")).alias("s")).collect()}
    assert (scores[0], scores[1], scores[2], scores[4], scores[7]) == (0, 2, 1, 3, 6)
    texts = ["select 1", "  \n INSERT into t", "Update t", "delete from t", "CREATE table t", "drop table t", "ALTER t", "EXPLAIN x", ""]
    kinds = spark.createDataFrame([(t,) for t in texts], "q string").select(w.statement_type(F.col("q")))
    assert [r[0] for r in kinds.collect()] == [
        "select", "insert", "update", "delete", "create", "drop", "alter", "select", "select",
    ]


def test_sizes_of_unknown_and_unmeasured_tables(statements, registry):
    found = rows(w.registered_sizes(statements, registry, "id").filter("id in (1, 5, 8)"), "id", "table_name", "expected_rows")
    assert found == [(1, "staff", 100_000), (1, "wards", 50), (5, "patient_data", 10_000_000), (8, "known", 2_000_000)]


def test_routing(statements, registry):
    found = {r.id: (r.target, r.reasons) for r in w.route(statements, registry, "id").collect()}
    assert found[0] == ("small", "")
    assert found[3] == ("large", "score,analytical")
    assert found[5] == ("large", "lake table,rows")
    assert found[6] == ("small", "")
    assert found[7] == ("large", "score,tables")
    assert found[8] == ("large", "rows")


def test_billing(spark):
    data = [("a", 10, True), ("a", 2_500, True), ("a", 9_000, False), ("b", None, True)]
    log = spark.createDataFrame(data, "tenant_id string, row_count long, bill boolean").withColumns(
        {"created": F.lit(dt.datetime(2024, 1, 1)), "engine": F.lit(None).cast("string")}
    )
    assert rows(metering.billing(log)) == [("a", 2, 3), ("b", 1, 1)]
    assert {r.type for r in metering.billing_events(log).collect()} == {"query"}


def test_unknown_counters_are_ignored(spark):
    events = spark.createDataFrame([("requests_total", 1), ("requests_total", 2), ("other", 5)], "metric string, value long")
    assert rows(metering.counters(events)) == [("requests_total", 3)]


def test_response_window(spark):
    log = spark.range(1500).select(F.col("id"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("us"))
    found = metering.response_times(log, "at", "us", "id").first()
    assert found[:] == (999.5, 1499, 500, 1000)
    assert metering.response_times(log.limit(0), "at", "us", "id").first().measurements == 0


def test_statements_of_unknown_tenants_are_not_logged(spark, small):
    known = spark.createDataFrame([("tenant_1",), ("tenant_1",), ("other",)], "tenant_id string")
    found = metering.log_entries(small.query_log, known)
    assert found.count() == small.query_log.filter("tenant_id = 'tenant_1'").count()


def test_lookup_lists_unknown_keys(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "x"), (3, "x"), (4, None)], "id int, k string")
    index = spark.createDataFrame([("A", "t1")], "name string, tenant string")
    found, missing = joins.lookup(facts, index, F.upper("k"), "name")
    assert rows(found, "id", "tenant") == [(1, "t1")]
    assert rows(missing) == sorted([("X", 2), (None, 1)], key=repr)


def test_log_keeps_whole_texts_and_the_table(spark):
    long = "SELECT * FROM ward_list WHERE note = '" + "x" * 212 + "'"
    texts = [long, "insert into app.visits values (1)", "UPDATE beds SET a = 1", "create table t2 (a int)", "SELECT 1"]
    log = spark.createDataFrame(
        [(i, "a" if i else "gone", t, "e", 5, None, dt.datetime(2024, 1, 1)) for i, t in enumerate(texts)],
        "query_id int, tenant_id string, query string, engine string, row_count long, latency_us long, created timestamp_ntz",
    )
    found = {r.query_id: r for r in metering.log_entries(log).collect()}
    assert len(long) == 251 and found[0].query == long and found[0].short_query == long[:200]
    assert [found[i].table for i in range(5)] == ["ward_list", "app.visits", "beds", "t2", None]
    known = spark.createDataFrame([("a",)], "tenant_id string")
    assert {r.query_id for r in metering.log_entries(log, known).collect()} == {1, 2, 3, 4}


def test_unknown_metrics_are_counted(spark):
    events = spark.createDataFrame([("requests_total", 1), ("odd", 5), ("odd", 1), (None, 1)], "metric string, value long")
    assert rows(metering.counters(events)) == [("requests_total", 1)]
    assert rows(metering.unknown_metrics(events)) == sorted([("odd", 2), (None, 1)], key=repr)


def test_response_window_is_an_argument(spark):
    log = spark.createDataFrame([(i, i) for i in range(10)], "t int, l long")
    assert metering.response_times(log, "t", "l", "t", window=3).first()[:] == (8.0, 9, 7, 3)
