from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import catalog, maintenance as mt, sinks

NOW = dt.datetime(2024, 2, 10)


def paths(spark, name):
    return set(mt.data_files(spark, name))


def test_update_and_delete_report_affected_rows(spark, namespace):
    name = f"{namespace}.t"
    data = [(1, "a"), (2, "b"), (3, None)]
    spark.createDataFrame(data, "id int, v string").write.saveAsTable(name)
    first = spark.table(name)
    assert first.count() == 3
    assert mt.update_rows(spark, name, F.col("v") == "a", {"v": F.lit("z"), "id": F.col("id") + 10}) == 1
    assert rows(spark.table(name)) == sorted([(11, "z"), (2, "b"), (3, None)], key=repr)
    # A null condition deletes nothing.
    assert mt.delete_rows(spark, name, F.col("v") == "b") == 1
    assert rows(spark.table(name)) == sorted([(11, "z"), (3, None)], key=repr)
    # A query on the first version still finds it, until it is expired.
    assert first.count() == 3
    assert mt.expire_versions(spark, name)
    assert spark.table(name).count() == 2


def test_old_versions_expire(spark, namespace):
    name = f"{namespace}.t"
    for n in (1, 2, 3):
        mt.publish(spark.range(n), name)
    mt.publish(spark.range(9), f"{namespace}.t2")
    assert len(mt.expire_versions(spark, name)) == 2
    assert mt.expire_versions(spark, name) == []
    assert (spark.table(name).count(), spark.table(f"{namespace}.t2").count()) == (3, 9)


def test_every_operation_works_on_every_table(spark, namespace):
    """Made by a sink, by partitions, by buckets, or published: one kind of table."""
    df = spark.range(40).select("id", (F.col("id") % 4).alias("p"))
    makers = {
        "sink": lambda n: sinks.append_or_create(df, n),
        "parts": lambda n: df.write.partitionBy("p").saveAsTable(n),
        "buckets": lambda n: sinks.write_bucketed(df, n, "id", "p", buckets=2),
        "published": lambda n: mt.publish(df, n, properties={"keeper": "it's me"}),
    }
    for kind, make in makers.items():
        name = f"{namespace}.{kind}"
        make(name)
        mt.set_properties(spark, name, {"note": "kept"})
        before = mt.layout_of(spark, name)
        sinks.append_or_create(spark.createDataFrame([(100, 1), (101, 7)], "id long, p long"), name)
        assert mt.update_rows(spark, name, F.col("p") == 2, {"id": F.col("id") + 1000}) == 10
        assert mt.delete_rows(spark, name, F.col("p") == 3) == 10
        mt.compact(spark, name)
        sinks.append_or_create(spark.createDataFrame([(200, 3)], "id long, p long"), name)
        assert mt.refresh_view(spark, name, lambda n=name: spark.table(n), NOW)
        assert not mt.refresh_view(spark, name, lambda n=name: spark.table(n), NOW)
        expected = [(i, i % 4) if i % 4 != 2 else (i + 1000, 2) for i in range(40) if i % 4 != 3]
        assert rows(spark.table(name), "id", "p") == sorted([*expected, (100, 1), (101, 7), (200, 3)], key=repr)
        assert mt.layout_of(spark, name) == before, kind
        assert mt.table_property(spark, name, "note") == "kept"
        mt.materialize(spark.range(3), name, "table")  # other columns
        assert rows(spark.table(name)) == [(0,), (1,), (2,)]
        assert mt.table_property(spark, name, "note") == "kept"
    assert mt.table_property(spark, f"{namespace}.published", "keeper") == "it's me"


def test_only_touched_partitions_are_written(spark, namespace):
    name = f"{namespace}.t"
    df = spark.range(60).select("id", F.when(F.col("id") % 6 < 5, F.concat(F.lit("k/="), F.col("id") % 6)).alias("p"))
    df.write.partitionBy("p").saveAsTable(name)
    before = paths(spark, name)
    assert mt.update_rows(spark, name, F.col("id") == 7, {"id": F.lit(700)}) == 1
    after = paths(spark, name)
    assert len({f.rsplit("/", 1)[0] for f in before - after}) == 1
    assert mt.delete_rows(spark, name, F.col("p").isNull()) == 10
    assert spark.table(name).count() == 50 and spark.table(name).where("p is null").count() == 0
    assert mt.delete_rows(spark, name, F.col("id") < 0) == 0
    # A row can move to another partition, there or new.
    assert mt.update_rows(spark, name, F.col("id") == 0, {"p": F.lit("k/=2")}) == 1
    assert mt.update_rows(spark, name, F.col("id") == 6, {"p": F.lit("new one")}) == 1
    found = {r.id: r.p for r in spark.table(name).collect()}
    assert (found[0], found[6], found[700], len(found)) == ("k/=2", "new one", "k/=1", 50)


def test_packing():
    assert mt.packed([], 10) == 0
    assert mt.packed([3, 3, 3], 10) == 1
    assert mt.packed([77] * 6, 100) == 6
    assert mt.packed([200, 50, 50], 100) == 2


def test_analyzed_table_has_statistics(spark, namespace):
    spark.range(7).write.saveAsTable(f"{namespace}.s")
    catalog.analyze(spark, f"{namespace}.s")
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {namespace}.s").filter("col_name = 'Statistics'").first()
    assert "7 rows" in details.data_type


def test_rewrite_keeps_partitions_and_column_order(spark, namespace):
    name = f"{namespace}.t"
    df = spark.range(10).select((F.col("id") % 2).alias("p"), "id")
    mt.publish(df, name, partition_by=("p",))
    mt.delete_rows(spark, name, F.col("id") < 5)
    assert spark.table(name).columns == ["id", "p"]  # partition columns come last, as in any table
    assert mt.layout_of(spark, name).partition_by == ("p",)


def test_compaction_keeps_rows_with_fewer_files(spark, namespace):
    name = f"{namespace}.t"
    mt.publish(spark.range(0, 10_000, 1, 16), name)
    before = len(mt.data_files(spark, name))
    assert mt.compact(spark, name)
    after = len(mt.data_files(spark, name))
    assert (before, after) == (16, 1)
    assert spark.table(name).count() == 10_000
    assert spark.table(name).agg(F.count_distinct("id")).first()[0] == 10_000
    assert not mt.compact(spark, name)  # nothing left to do


def test_compaction_to_a_target_size(spark, namespace):
    name = f"{namespace}.t"
    mt.publish(spark.range(0, 200_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), name)
    total = sum(mt.data_files(spark, name).values())
    assert mt.compact(spark, name, target_bytes=total // 4)
    assert 3 <= len(mt.data_files(spark, name)) <= 8
    assert spark.table(name).count() == 200_000


def test_compaction_settles(spark, namespace):
    name = f"{namespace}.t"
    mt.publish(spark.range(0, 60_000, 1, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("h")), name)
    largest = max(mt.data_files(spark, name).values())
    assert not mt.compact(spark, name, target_bytes=int(largest / 0.77))  # no two fit together
    target = int(largest * 2.5)
    assert mt.compact(spark, name, target)
    assert not mt.compact(spark, name, target)


def test_partitioned_compaction_settles_and_leaves_other_partitions(spark, namespace):
    name = f"{namespace}.t"
    many = spark.range(0, 8000, 1, 8).select("id", F.lit("many").alias("p"))
    one = spark.range(0, 10, 1, 1).select("id", F.lit("one").alias("p"))
    many.write.partitionBy("p").saveAsTable(name)
    sinks.append_or_create(one, name)
    kept = {f for f in paths(spark, name) if "p=one" in f}
    assert len(paths(spark, name)) == 9
    assert mt.compact(spark, name)
    assert not mt.compact(spark, name)
    assert len(paths(spark, name)) == 2 and kept < paths(spark, name)
    assert (spark.table(name).count(), spark.table(name).select("id").distinct().count()) == (8010, 8000)


def test_snapshots_refer_to_files(spark, namespace):
    name = f"{namespace}.plain"
    spark.range(3).write.saveAsTable(name)
    mt.publish(spark.range(4).select("id", (F.col("id") % 2).alias("p")), f"{namespace}.parts", partition_by=("p",))
    assert mt.snapshot(spark, namespace, NOW) == ["parts", "plain"]
    files = paths(spark, name)
    sinks.append_or_create(spark.range(10, 12), name)
    mt.delete_rows(spark, f"{namespace}.parts", F.col("p") == 1)
    assert mt.snapshot(spark, namespace, NOW + dt.timedelta(hours=1)) == ["parts", "plain"]
    mt.delete_rows(spark, name, F.col("id") == 0)
    mt.expire_versions(spark, name)
    mt.expire_versions(spark, f"{namespace}.parts")
    assert rows(mt.history(spark, name)) == [("20240210_000000", 3), ("20240210_010000", 5)]
    assert mt.history(spark, name).first().snapshot_ts == "20240210_010000"
    assert rows(mt.read_snapshot(spark, name, "20240210_000000")) == [(0,), (1,), (2,)]
    assert mt.read_snapshot(spark, name, "20240210_010000").count() == 5
    read = mt.read_snapshot(spark, name, "20240210_000000").inputFiles()
    assert read and {mt.plain_path(f) for f in read} <= {mt.plain_path(f) for f in files}  # nothing was copied
    parts = f"{namespace}.parts"
    assert rows(mt.read_snapshot(spark, parts, "20240210_000000"), "id", "p") == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert rows(mt.read_snapshot(spark, parts, "20240210_010000"), "id", "p") == [(0, 0), (2, 0)]


def test_snapshots_go_by_name(spark, namespace):
    name = f"{namespace}.t"
    mt.publish(spark.createDataFrame([(1, "x")], "a int, b string"), name)
    mt.snapshot(spark, namespace, NOW)
    mt.publish(spark.createDataFrame([("y", 2, 3.5)], "b string, a int, c double"), name)
    mt.snapshot(spark, namespace, NOW + dt.timedelta(hours=1))
    assert rows(mt.read_snapshot(spark, name, "20240210_000000"), "a", "b", "c") == [(1, "x", None)]
    assert rows(mt.read_snapshot(spark, name, "20240210_010000"), "a", "b", "c") == [(2, "y", 3.5)]
    mt.publish(spark.createDataFrame([("y", "z")], "b string, a string"), name)
    with pytest.raises(ValueError, match="a was int and is string"):
        mt.read_snapshot(spark, name, "20240210_000000")


def test_names_of_tenants_are_legal_and_apart(spark):
    tenants = ["acme", "ACME", "default-tenant", "a.b", "a b", "ü", "a_b", "a__2d__b"]
    names = [mt.namespace_of(t) for t in tenants]
    assert len(set(names)) == len(names)
    for tenant, name in zip(tenants[2:5], names[2:5]):
        mt.create_namespace(spark, name)
        mt.publish(spark.range(2), f"{name}.t", properties={"tenant": tenant})
        mt.update_rows(spark, f"{name}.t", F.col("id") == 1, {"id": F.lit(5)})
        assert rows(spark.table(f"{name}.t")) == [(0,), (5,)]
        mt.drop_namespace(spark, name)


def test_expiry_keeps_the_newest(spark, namespace):
    spark.range(3).write.saveAsTable(f"{namespace}.t")
    for days in (20, 10, 8):
        mt.snapshot(spark, namespace, NOW - dt.timedelta(days=days))
    expired = mt.expire_snapshots(spark, f"{namespace}.t", NOW, "9d")
    assert expired == ["20240121_000000", "20240131_000000"]
    # Even when it is old.
    assert mt.expire_snapshots(spark, f"{namespace}.t", NOW, "1d") == []
    assert mt.history(spark, f"{namespace}.t").count() == 1


def test_refresh_waits_for_its_interval(spark, namespace):
    name = f"{namespace}.mv"
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert mt.refresh_view(spark, name, build, NOW, "1h")
    assert not mt.refresh_view(spark, name, build, NOW + dt.timedelta(minutes=59), "1h")
    assert mt.refresh_view(spark, name, build, NOW + dt.timedelta(hours=1), "1h")
    assert spark.table(name).count() == 2
    assert [t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary] == ["mv"]
    assert mt.expire_versions(spark, name) == []  # the replaced version is gone


def test_refresh_after_compaction_and_of_any_table(spark, namespace):
    name = f"{namespace}.mv"
    mt.refresh_view(spark, name, lambda: spark.range(0, 100, 1, 8), NOW)
    assert mt.compact(spark, name)
    assert not mt.refresh_view(spark, name, lambda: spark.range(3), NOW + dt.timedelta(minutes=5))
    assert mt.refresh_view(spark, name, lambda: spark.range(3), NOW + dt.timedelta(hours=2))
    assert spark.table(name).count() == 3


def test_intervals():
    assert mt.interval("90s") == dt.timedelta(seconds=90)
    assert mt.interval("15m") == dt.timedelta(minutes=15)
    assert mt.interval("7d") == dt.timedelta(days=7)
    with pytest.raises(ValueError):
        mt.interval("soon")


def test_materialization_and_names(spark, namespace):
    mt.materialize(spark.range(2), f"{namespace}_v", "view")
    assert spark.table(f"{namespace}_v").count() == 2
    for n in (2, 3):
        mt.materialize(spark.range(n), f"{namespace}.m", "table")
    assert spark.table(f"{namespace}.m").count() == 3
    with pytest.raises(ValueError):
        mt.materialize(spark.range(1), "x", "index")
    assert mt.mart_namespace("main", None) == "main"
    assert mt.mart_namespace("main", " marts ") == "main_marts"


def test_namespaces(spark):
    mt.create_namespace(spark, "tenant_temporary")
    mt.create_namespace(spark, "tenant_temporary")
    spark.range(1).write.saveAsTable("tenant_temporary.t")
    assert "tenant_temporary" in catalog.list_namespaces(spark)
    mt.drop_namespace(spark, "tenant_temporary")
    assert "tenant_temporary" not in catalog.list_namespaces(spark)


def test_listing_description_and_info(spark, namespace):
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").saveAsTable(f"{namespace}.t")
    assert catalog.list_tables(spark, {"lake": namespace}) == ["lake.t"]
    assert rows(catalog.describe(spark, f"{namespace}.t")) == [(1, "id", "bigint"), (2, "p", "bigint")]
    info = catalog.table_info(spark, f"{namespace}.t")
    assert info["history"] is None
    assert rows(info["partitions"], "p", "rows") == [(0, 2), (1, 2)]
    spark.range(1).write.saveAsTable(f"{namespace}.flat")
    mt.snapshot(spark, namespace, NOW)
    flat = catalog.table_info(spark, f"{namespace}.flat")
    assert flat["partitions"] is None and flat["history"].count() == 1
    assert "spark_catalog" in catalog.list_catalogs(spark)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (4, None)], "n int, t string")
    found = {r.column_name: r for r in catalog.statistics(df, exact=True).collect()}
    assert (found["n"].null_share, found["n"].distinct_values, found["n"].low_value, found["n"].high_value) == (0.25, 3, "1", "4")
    assert (found["t"].distinct_values, found["t"].low_value) == (2, None)
    assert found[None].row_count == 4
    empty = {r.column_name: r for r in catalog.statistics(df.limit(0)).collect()}
    assert empty["n"].null_share is None and empty[None].row_count == 0


def test_settings_merge_and_order(spark):
    updates = spark.createDataFrame(
        [
            ("acme", "tier", "gold", dt.datetime(2024, 1, 1), 1),
            ("acme", "region", "eu", dt.datetime(2024, 1, 2), 2),
            ("acme", "tier", "silver", dt.datetime(2024, 1, 3), 3),
            ("beta", "tier", "free", dt.datetime(2024, 1, 1), 4),
        ],
        "tenant_id string, config_key string, config_value string, updated_at timestamp_ntz, update_id long",
    )
    current = catalog.upsert_settings(None, updates)
    later = spark.createDataFrame([("beta", "tier", "gold", dt.datetime(2024, 1, 5), 5)], updates.schema)
    merged = catalog.upsert_settings(current, later)
    table = {r.tenant_id: r for r in catalog.tenant_table(merged).collect()}
    assert table["acme"].config == {"tier": "silver", "region": "eu"}
    assert table["beta"].config == {"tier": "gold"}
    assert (table["beta"].created_at, table["beta"].updated_at) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5))


def test_many_settings_spread_over_full_pages(spark):
    updates = spark.range(2510).select(
        F.when(F.col("id") < 2500, "big").otherwise("small").alias("tenant_id"),
        F.format_string("k%04d", "id").alias("config_key"),
        F.col("id").cast("string").alias("config_value"),
        F.lit(NOW).cast("timestamp_ntz").alias("updated_at"),
        F.col("id").alias("update_id"),
    )
    found = catalog.tenant_table(catalog.upsert_settings(None, updates)).collect()
    pages = {(r.tenant_id, r.page): r.config for r in found}
    assert {k: len(v) for k, v in pages.items()} == {("big", 0): 1000, ("big", 1): 1000, ("big", 2): 500, ("small", 0): 10}
    assert min(pages["big", 1]) == "k1000" and max(pages["big", 1]) == "k1999"


def test_dataset_registration(spark, namespace):
    for n in (1, 2):
        catalog.register_dataset(spark, f"{namespace}.datasets", "a", f"d{n}", "small", 10 * n, 3, NOW)
    assert rows(spark.table(f"{namespace}.datasets"), "name", "rows") == [("d1", 10), ("d2", 20)]
