from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from lakeward.functions import columns as c, sql
from lakeward.plans import models as m


def values(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_flags_strict_and_normalized(spark):
    texts = [("Yes",), (" yes ",), ("YES",), ("no",), (None,)]
    assert values(spark, texts, "t string", c.flag_exact("t")) == [1, 0, 0, 0, 0]
    assert values(spark, texts, "t string", c.flag("t")) == [1, 1, 1, 0, 0]


def test_tristate_leaves_others_null(spark):
    texts = [("Positive",), ("Negative",), ("Unknown",), (None,)]
    assert values(spark, texts, "t string", c.tristate("t", "Positive", "Negative")) == [1, 0, None, None]


def test_bands(spark):
    ages = [(0,), (17,), (18,), (64,), (65,), (None,)]
    assert values(spark, ages, "a int", c.age_group("a")) == [
        "Child", "Child", "Adult", "Adult", "Senior", "Senior",
    ]
    rates = [(75.01,), (75.0,), (50.0,), (None,)]
    assert values(spark, rates, "r double", c.risk_band("r")) == [
        "High Risk", "Medium Risk", "Low Risk", "Low Risk",
    ]


def test_percent_of_nothing_is_null(spark):
    data = [(1, 3), (0, 0)]
    assert values(spark, data, "a int, b int", c.percent(F.col("a"), F.col("b"))) == [33.33, None]


def test_lenient_numbers(spark):
    texts = [("3.7",), ("4",), (" 5 ",), ("abc",), ("",), ("1e2",), (None,), ("99999999999",)]
    assert values(spark, texts, "t string", c.lenient_int("t")) == [4, 4, 5, None, None, 100, None, None]
    assert values(spark, texts, "t string", c.lenient_bigint("t")) == [
        None, 4, 5, None, None, None, None, 99999999999,
    ]
    assert values(spark, [(3.7,), (3.2,)], "v double", c.rounded_int("v")) == [4, 3]


def test_concat_and_day_of_week(spark):
    assert values(spark, [("a", None, "b")], "x string, y string, z string", c.concat_skip_nulls("x", "y", "z")) == ["ab"]
    sunday = [(dt.datetime(2024, 1, 7),), (dt.datetime(2024, 1, 8),)]
    assert values(spark, sunday, "d timestamp_ntz", c.day_of_week("d")) == [0, 1]


def test_json_keeps_null_members_and_reads_missing_ones_as_null(spark):
    made = values(spark, [(None, "x")], "a int, b string", c.json_object({"a": F.col("a"), "b": F.col("b")}))
    assert made == ['{"a":null,"b":"x"}']
    texts = [('{"age": 41}',), ('{"name": "x"}',), ("no json",), (None,)]
    assert values(spark, texts, "t string", c.json_value("t", "age", "int")) == [41, None, None, None]


def test_pick_wraps_and_draws_repeat(spark):
    picked = spark.range(5).select(c.pick(["a", "b"], F.col("id")))
    assert [r[0] for r in picked.collect()] == ["a", "b", "a", "b", "a"]
    draw = c.seeded_number("id", 7, "x").alias("n")
    first = spark.range(100).select("id", draw)
    again = spark.range(100).repartition(7).select("id", draw)
    assert sorted(first.collect()) == sorted(again.collect())
    assert first.select("n").distinct().count() == 100


def test_later_map_value_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert df.select(c.merge_maps("x", "y")).first()[0] == {"a": "1", "b": "3", "c": "4"}


@pytest.mark.parametrize("kind", [T.TimestampNTZType(), T.TimestampType(), T.DateType()])
def test_recent_filter_reaches_the_scan(spark, small, kind):
    df = small.events.withColumn("when", F.col("ts").cast(kind)) if not isinstance(kind, T.TimestampNTZType) else small.events
    column = "ts" if isinstance(kind, T.TimestampNTZType) else "when"
    found = m.recent(df, column, 30, dt.datetime(2024, 2, 10))
    assert 0 < found.count() < small.events.count()
    if column == "ts":
        plan = found.select("event_id")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan
        assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_statements_of_other_engines(spark):
    sql.register_functions(spark)
    df = spark.createDataFrame([('{"a": {"b": 3}}', dt.datetime(2024, 1, 7))], "j string, ts timestamp_ntz")
    df.withColumnRenamed("j", "Some Text").createOrReplaceTempView("foreign_view")
    found = sql.run_sql(
        spark,
        """SELECT json_extract_scalar("Some Text", '$.a.b') AS x, day_of_week(ts) AS d, :p AS p FROM foreign_view""",
        {"p": 'say "x"'},
    )
    assert found.first()[:] == ("3", 0, 'say "x"')
    # Outside such a statement double quotes still make strings.
    assert spark.sql('select "text" as t').first().t == "text"
