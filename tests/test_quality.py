from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import layout, quality as q

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2024, 2, 10)


@pytest.fixture(scope="module")
def people(spark):
    data = [
        (1, "Alice", 25, "New York", None),
        (2, "Bob", 30, "12", None),
        (2, "Bob", 30, "12", None),
        (3, None, 200, "2024-01-05", None),
        (4, "Eve", None, "true", None),
    ]
    return spark.createDataFrame(data, "id long, name string, age int, city string, note string")


def test_nulls_uniqueness_and_ranges(people):
    assert q.null_rows(people, "name").count() == 1
    assert rows(q.repeated(people, "id")) == [(2, 2)]
    assert rows(q.repeated(people, "note")) == []
    assert rows(q.repeated(people, "name", "note")) == [("Bob", None, 2)]
    assert [r.id for r in q.outside_range(people, "age", 0, 120).collect()] == [3]


def test_nulls_pass_accepted_values(people):
    assert rows(q.unexpected_values(people, "name", ["Alice", "Eve"])) == [("Bob", 2)]


@pytest.mark.parametrize("days, status", [(0.1, "pass"), (2, "warn"), (9, "error")])
def test_freshness_by_age(spark, days, status):
    df = spark.createDataFrame([(NOW - days * DAY,), (None,)], "ts timestamp_ntz")
    assert q.freshness(df, "ts", DAY, 3 * DAY, NOW).first().status == status


def test_freshness_of_an_empty_table_is_an_error(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz")
    assert q.freshness(df, "ts", DAY, 3 * DAY, NOW).first().status == "error"


def test_profile_scans_once(people):
    found = q.profile(people, {"name": ["Alice"], "age": None})
    assert rows(found) == [
        ("age", "null_count", 5, 1, 20.0),
        ("name", "null_count", 5, 1, 20.0),
        ("name", "unexpected_values", 4, 3, 75.0),
    ]


def test_profile_reads_the_table_once(small):
    plan = q.profile(small.events, {"event_type": ["click"], "value": None})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_summary_lists_only_models_with_failures(people):
    bad = {"null_names": F.col("name").isNull()}
    good = {"null_ids": F.col("id").isNull()}
    models = {"bad": (people, bad), "good": (people, good)}
    assert rows(q.summary(models), "model_name", "null_names", "null_ids") == [("bad", 1, 0)]
    assert q.summary(models, all_models=True).count() == 2


def test_mixed_kinds(people):
    found = {r.column_name: (set(r.kinds), r.mixed) for r in q.mixed_columns(people).collect()}
    assert found["city"] == ({"int", "date", "boolean", "text"}, True)
    assert found["name"] == ({"text"}, False)
    assert found["note"] == (set(), False)


def test_mixed_without_text_columns(spark):
    assert q.mixed_columns(spark.range(3)).count() == 0


def test_duplicates_and_all_null(people, spark):
    assert q.duplicate_rows(people).first()[0] == 1
    assert rows(q.all_null_columns(people)) == [("note",)]
    assert q.duplicate_rows(spark.range(0)).first()[0] == 0


def test_issue_list(people):
    found = {(r.issue, r.column_name): r.figure for r in q.issues(people).collect()}
    assert found == {("all_null", "note"): 5, ("duplicates", None): 1, ("mixed", "city"): 4}
    report = q.validate(people, q.Limits(max_bytes=10))
    assert not report.ok and report.rows == 5
    assert any("more than 10" in message for message in report.messages)


def test_empty_frame_has_one_issue(people, spark):
    assert [r.issue for r in q.issues(people.filter("id < 0")).collect()] == ["empty"]
    assert q.validate(spark.range(3).toDF("id")).ok


def test_severity_raises_on_errors_only(people):
    warn = q.with_severity({"names": (q.null_rows(people, "name"), "warn")})
    assert warn.first().result == "warn"
    q.enforce(warn)
    error = q.with_severity({"names": (q.null_rows(people, "name"), "error")})
    with pytest.raises(q.QualityError, match="names"):
        q.enforce(error)


def test_row_bytes_counts_utf8(spark):
    df = spark.createDataFrame([("é", 1, None, [1, 2])], "t string, i int, n double, a array<int>")
    measured = layout.size_of(df).first()
    assert (measured.rows, measured.bytes) == (1, 2 + 4 + len('{"a":[1,2]}'))


def test_size_targets(spark):
    assert layout.size_class(1_000_000, 500 * 1024 * 1024) == "small"
    assert layout.size_class(1_000_001, 0) == layout.size_class(1, 500 * 1024 * 1024 + 1) == "large"
    targets = spark.createDataFrame([(100_000,), (100_001,)], "n long").select(layout.upload_target(F.col("n")))
    assert [r[0] for r in targets.collect()] == ["small", "large"]


def test_declared_checks(people):
    checks = [
        q.Check("not_null", ("name",)),
        q.Check("accepted_values", ("name",), ("Alice", "Bob"), severity="warn"),
        q.Check("accepted_range", ("age",), (0, 120)),
        q.Check("unique", ("id", "name")),
        q.Check("not_null", ("id",)),
    ]
    found = {r.check_name: (r.failures, r.result) for r in q.run_checks(people, checks).collect()}
    assert found == {
        "not_null_name": (1, "error"),
        "accepted_values_name": (1, "warn"),
        "accepted_range_age": (1, "error"),
        "unique_id_name": (1, "error"),
        "not_null_id": (0, "pass"),
    }
    with pytest.raises(q.QualityError, match="accepted_range_age"):
        q.enforce(q.run_checks(people, checks))
    with pytest.raises(ValueError, match="unknown check"):
        q.run_checks(people, [q.Check("pretty", ("id",))])


def shuffled(spark, run):
    """Bytes that a run writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))

    before = written()
    result = run()
    return written() - before, result


def test_rows_that_are_there_once_are_not_shuffled_whole(spark, small):
    rows_once = small.orders.unionByName(small.orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    rows_once = rows_once.withColumn("note", F.sha2(F.col("o_orderkey").cast("string"), 512))
    plain_bytes, _ = shuffled(spark, lambda: rows_once.groupBy(*rows_once.columns).count().agg(F.sum("count")).collect())
    taken, found = shuffled(spark, lambda: q.duplicate_rows(rows_once).first()[0])
    assert found == 0 and taken < plain_bytes / 8
    again = rows_once.unionByName(rows_once.where("o_orderkey % 50 = 0"))
    taken, found = shuffled(spark, lambda: q.duplicate_rows(again).first()[0])
    assert found == rows_once.where("o_orderkey % 50 = 0").count() > 0 and taken < plain_bytes / 4


def test_duplicates_with_nulls_nested_values_and_a_hot_row(spark):
    nan, zero = float("nan"), 0.0
    data = [
        (None, "a", nan, [1, None], {"k": 1}), (None, "a", float("nan"), [1, None], {"k": 1}),
        ("a", None, zero, [], None), ("a", None, -zero, [], None), (None, "a", zero, [], None),
        ("x", "y", 1.0, None, {"k": 1}), ("x", "y", 1.0, None, {"k": 2}),  # differ in the map alone
    ]
    data += [("hot", "row", 2.0, [7], {"h": 0})] * 500
    df = spark.createDataFrame(data, "a string, `b c` string, d double, e array<int>, f map<string,int>")
    assert q.duplicate_rows(df).first()[0] == 1 + 1 + 499
    assert q.duplicate_rows(df.select("a", "`b c`")).first()[0] == len(data) - df.select("a", "`b c`").distinct().count()
    assert q.duplicate_rows(spark.range(4).select()).first()[0] == 3
    assert q.duplicate_rows(spark.range(0).select()).first()[0] == 0


def test_repeated_texts_and_combinations(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2), ("b", None), ("b", None), (None, None)], "t string, n int")
    assert rows(q.repeated(df, "t")) == [("a", 2), ("b", 2)]
    assert rows(q.repeated(df, "t", "n")) == sorted([(None, 1, 2), ("b", None, 2)], key=repr)
    assert rows(q.repeated(df, "n")) == [(1, 3)]
    assert q.repeated(df.filter("false"), "t", "n").count() == 0


def test_digests_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(q, "_digest", lambda df: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "n int, t string")
    assert q.duplicate_rows(df).first()[0] == 1 and rows(q.repeated(df, "n", "t")) == [(1, "a", 2)]
