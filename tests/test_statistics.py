"""Statistics kept per load or partition against one pass over the whole table."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import catalog, statistics as s
from lakeward.session import fresh_path

EXACT = ["column_name", "null_share", "low_value", "high_value", "row_count"]


@pytest.fixture(scope="module")
def table(spark):
    data = [
        (
            i, i % 50, f"t{i % 7}", None if i % 9 == 0 else i / 4 - 3, -0.0 if i % 2 else 0.0,
            dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), dt.datetime(2024, 1, 1, 0, 0, i % 60), Decimal(i) / 8,
            i % 3 == 0, [i % 4], {"k": i % 2}, None, bytes([i % 5]),
        )
        for i in range(4000)
    ]
    schema = """id long, `group no` smallint, part string, value double, zero double, day date, at timestamp_ntz,
      amount decimal(20,3), flag boolean, list array<int>, map map<string,int>, nothing string, raw binary"""
    return spark.createDataFrame(data, schema)


def test_merged_loads_equal_one_pass(spark, table):
    path = fresh_path(spark, "statistics")
    for load in (0, 1, 2, 1):
        s.record_load(table.where(F.col("id") % 3 == load), path, f"load {load}")
    found = s.recorded(spark, path, table.schema)
    whole = catalog.statistics(table.drop("map").withColumn("zero", F.lit(0.0)), exact=True)
    assert rows(found.where("column_name <> 'map' or column_name is null"), *EXACT) == rows(whole, *EXACT)
    exact = {r.column_name: r.distinct_values for r in whole.collect()} | {"map": 2}
    for r in found.where("column_name is not null").collect():
        assert abs(r.distinct_values - exact[r.column_name]) <= max(1, s.ERROR * exact[r.column_name]), r
    assert {r.column_name: r.distinct_values for r in found.collect()}["zero"] == 1


def test_merged_sketches_equal_the_sketch_of_all_rows(spark, table):
    at_once = s.merged(s.partial_statistics(table), table.schema)
    path = fresh_path(spark, "statistics")
    for load in range(5):
        s.record_load(table.where(F.col("id") % 5 == load), path, str(load))
    assert rows(s.recorded(spark, path, table.schema).drop("distinct_values")) == rows(at_once.drop("distinct_values"))


def test_an_append_reads_its_own_rows_only(spark, table):
    base, path = fresh_path(spark, "table"), fresh_path(spark, "statistics")
    table.drop("map").write.partitionBy("part").parquet(base)
    stored = spark.read.parquet(base)
    s.record_partitions(stored, path, ["part"])
    more = stored.where("part = 't1'").withColumn("id", F.col("id") + 100_000)
    more.write.mode("append").partitionBy("part").parquet(base)
    stored = spark.read.parquet(base)
    touched = stored.where("part = 't1'")
    plan = s.partial_statistics(touched, ["part"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    s.record_partitions(touched, path, ["part"])
    kept = spark.read.parquet(path)
    assert kept.count() == 7
    measured = stored.drop("part")
    assert rows(s.recorded(spark, path, stored.schema, ["part"]), *EXACT) == rows(catalog.statistics(measured.withColumn("zero", F.lit(0.0)), exact=True), *EXACT)
    plan = s.recorded(spark, path, stored.schema, ["part"])._jdf.queryExecution().executedPlan().toString()
    assert base not in plan  # the table is not read for them


def test_estimates_of_many_values_stay_within_the_error(spark):
    path = fresh_path(spark, "statistics")
    df = spark.range(300_000).select("id", F.sha1(F.col("id").cast("string")).alias("text"))
    for load in range(4):  # loads overlap: their values are not counted twice
        s.record_load(df.where(F.col("id") >= load * 50_000), path, str(load))
    for r in s.recorded(spark, path, df.schema).where("column_name is not null").collect():
        assert abs(r.distinct_values - 300_000) <= s.ERROR * 300_000


def test_empty_loads_and_reserved_names(spark, table):
    path = fresh_path(spark, "statistics")
    s.record_load(table.where("false"), path, "none")
    found = {r.column_name: r for r in s.recorded(spark, path, table.schema).collect()}
    assert found[None].row_count == 0 and found["id"].null_share is None
    assert found["id"].distinct_values == 0 and found["id"].low_value is None
    with pytest.raises(ValueError, match="_load_id"):
        s.record_load(table.withColumn("_load_id", F.lit(1)), path, "x")


def test_exact_counts_do_not_copy_rows_once_per_column(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "b", -0.0), (None, None, 0.0)], "i int, s string, d double")
    found = catalog.statistics(df, exact=True)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {r.column_name: r.distinct_values for r in found.collect() if r.column_name}
    assert counts == {"i": 2, "s": 2, "d": 2}
