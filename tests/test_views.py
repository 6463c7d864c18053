"""Views refreshed from changed partitions against the same view built anew."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import views
from lakeward.session import delete_path, fresh_path

@pytest.fixture
def view(spark):
    positive = F.try_divide(F.col("positive").cast("double"), F.col("_rows"))
    return views.View(
        keys={"kind": F.col("kind"), "big": F.col("n") > 50},
        sums={"cents": F.col("cents"), "positive": (F.col("n") % 2 == 0).cast("long"), "known": F.col("note").isNotNull().cast("int")},
        shown={"rows": F.col("_rows"), "cents": F.col("cents"), "share": positive, "known": F.col("known")},
    )


@pytest.fixture
def table(spark):
    path = fresh_path(spark, "table")
    data = [
        (i, f"k{i % 5}" if i % 11 else None, i % 97, None if i % 4 == 0 else i * 7, None if i % 3 else "x", f"d{i % 6}" if i % 13 else None)
        for i in range(1200)
    ]
    df = spark.createDataFrame(data, "id long, kind string, n int, cents long, note string, day string")
    df.withColumn("cents", F.col("cents").cast("decimal(12,0)")).write.partitionBy("day").parquet(path)
    return path


def rebuilt(spark, table, view):
    added = view.added(spark.read.parquet(table), ["day"]).drop("day")
    return view.combined(added).select(*view.keys, *[c.alias(n) for n, c in view.shown.items()])


def replace(spark, table, day, change):
    """Rewrite one partition."""
    kept = change(spark.read.parquet(table).where(F.col("day") == day)).drop("day").collect()
    schema = spark.read.parquet(table).drop("day").schema
    spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{table}/day={day}")


def test_updates_deletes_appends_and_dropped_partitions(spark, table, view):
    path = fresh_path(spark, "view")
    with pytest.raises(ValueError, match="nothing"):
        views.current(spark, view, path)

    def check(partitions):
        assert views.refresh(spark.read.parquet(table), view, path, ["day"]) == partitions
        assert rows(views.current(spark, view, path)) == rows(rebuilt(spark, table, view))

    check(7)
    check(0)
    replace(spark, table, "d1", lambda df: df.withColumn("kind", F.lit("new")).withColumn("n", F.col("n") + 40))  # update
    replace(spark, table, "d2", lambda df: df.where("id % 4 = 0"))  # delete
    check(2)
    schema = spark.read.parquet(table).schema
    more = spark.createDataFrame([(9, "k1", 5, Decimal(10), None, "d9"), (10, None, 5, None, "y", None)], schema)
    more.write.mode("append").partitionBy("day").parquet(table)  # a new partition, and more of the one without a day
    check(2)
    delete_path(spark, f"{table}/day=d1")
    check(1)
    assert "new" not in {r.kind for r in views.current(spark, view, path).collect()}
    replace(spark, table, "d2", lambda df: df.withColumn("cents", -F.col("cents")))  # changed twice
    check(1)


def test_a_refresh_reads_changed_partitions_only(spark, table, view):
    path = fresh_path(spark, "view")
    views.refresh(spark.read.parquet(table), view, path, ["day"])
    replace(spark, table, "d3", lambda df: df.where("id % 9 = 0"))
    source = spark.read.parquet(table)
    _, changed, gone = views.changed_partitions(source, path, ["day"])
    assert changed == [("d3",)] and gone == []
    files = views._in(source, ["day"], changed).select(F.col("_metadata.file_path")).distinct().collect()
    assert files and all("day=d3" in r.file_path for r in files)
    plan = view.added(views._in(source, ["day"], changed), ["day"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(day" in plan or "PartitionFilters: [isnotnull(day" in plan


def test_a_refresh_that_failed_can_be_repeated(spark, table, view, monkeypatch):
    path = fresh_path(spark, "view")
    views.refresh(spark.read.parquet(table), view, path, ["day"])
    replace(spark, table, "d4", lambda df: df.withColumn("kind", F.lit("later")))
    combined = views.View.combined
    for _ in range(2):
        monkeypatch.setattr(views.View, "combined", lambda self, signed: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            views.refresh(spark.read.parquet(table), view, path, ["day"])
        monkeypatch.setattr(views.View, "combined", combined)
        assert views.last_refresh(spark, path) == 1
    assert views.refresh(spark.read.parquet(table), view, path, ["day"]) == 1
    assert rows(views.current(spark, view, path)) == rows(rebuilt(spark, table, view))


def test_floating_sums_are_refused(spark, table):
    view = views.View(keys={"kind": F.col("kind")}, sums={"mean": F.col("n") / 2})
    with pytest.raises(ValueError, match="mean is summed as double"):
        views.refresh(spark.read.parquet(table), view, fresh_path(spark, "view"), ["day"])
