from __future__ import annotations

import datetime as dt
import glob

import pyarrow as pa
import pytest
from conftest import rows, settings
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakeward.operators import layout, maintenance, sinks
from lakeward.plans import load_and_model

NOW = dt.datetime(2024, 2, 10)


def test_first_write_fixes_the_schema_and_inserts_go_by_position(spark, namespace):
    table = f"{namespace}.t"
    sinks.append_or_create(spark.createDataFrame([(1, 2)], "a int, b int"), table)
    sinks.append_or_create(spark.createDataFrame([(3, 4)], "b int, a int"), table)
    assert rows(spark.table(table)) == [(1, 2), (3, 4)]
    sinks.append_or_create(spark.createDataFrame([(5, 6)], "b int, a int"), table, by_name=True)
    assert rows(spark.table(table)) == [(1, 2), (3, 4), (6, 5)]
    with pytest.raises(AnalysisException):
        sinks.append_or_create(spark.range(1), table)


def test_targets(spark, namespace):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "id int, day date")
    sinks.create_table(df, f"{namespace}.lake", sinks.LAKE)
    assert dict(spark.table(f"{namespace}.lake").dtypes) == {"id": "int", "day": "string"}
    with pytest.raises(AnalysisException):
        sinks.create_table(df, f"{namespace}.lake", sinks.LAKE)
    for _ in range(2):
        sinks.create_table(df, f"{namespace}.local", sinks.LOCAL)
    assert spark.table(f"{namespace}.local").count() == 2
    sinks.insert(df, f"{namespace}.lake", sinks.LAKE)
    sinks.insert(df, f"{namespace}.local", sinks.LOCAL, mode="overwrite")
    assert (spark.table(f"{namespace}.lake").count(), spark.table(f"{namespace}.local").count()) == (2, 1)
    for call in (sinks.create_table, sinks.insert):
        with pytest.raises(ValueError, match="unknown target"):
            call(df, f"{namespace}.t", "elsewhere")


def test_ctas_and_insert_select_report_failure(spark, namespace):
    assert sinks.create_table_as(spark, f"{namespace}.a", "select 1 as x", {"keeper": "me"}) is None
    assert "ALREADY_EXISTS" in sinks.create_table_as(spark, f"{namespace}.a", "select 1 as x")
    assert "nowhere" in sinks.create_table_as(spark, f"{namespace}.b", "select nothing from nowhere")
    assert sinks.insert_select(spark, f"{namespace}.a", "select 2") is None
    assert "INSERT_COLUMN_ARITY_MISMATCH" in sinks.insert_select(spark, f"{namespace}.a", "select 1, 2")
    assert rows(spark.table(f"{namespace}.a")) == [(1,), (2,)]
    assert maintenance.table_property(spark, f"{namespace}.a", "keeper") == "me"


def test_types_without_a_lake_type_become_text(spark):
    df = spark.sql("select 1 as i, cast(1.5 as decimal(5,2)) as d, date'2024-01-01' as day, timestamp_ntz'2024-01-01 00:00:00' as ts, array(1) as a, cast(1 as smallint) as s, true as b")
    assert dict(layout.coerce_types(df).dtypes) == {
        "i": "int", "d": "string", "day": "string", "ts": "timestamp_ntz", "a": "string", "s": "string", "b": "boolean",
    }


def test_partitioned_files(spark, tmp_path):
    df = spark.range(100).withColumn("tenant_id", F.concat(F.lit("t"), F.col("id") % 3))
    path = str(tmp_path / "out")
    sinks.write_partitioned(df, path)
    assert {p.rsplit("=")[-1] for p in glob.glob(f"{path}/tenant_id=*")} == {"t0", "t1", "t2"}
    assert all(f.endswith(".snappy.parquet") for f in glob.glob(f"{path}/*/*.parquet"))
    assert rows(spark.read.parquet(path), "id") == sorted([(i,) for i in range(100)], key=repr)
    plain = str(tmp_path / "plain")
    sinks.write_partitioned(spark.range(5), plain)
    assert spark.read.parquet(plain).count() == 5


def test_hot_tenant_is_split_over_files(spark, tmp_path):
    # Random text does not compress, so a small advisory size splits the tenant.
    hot = spark.range(0, 40_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 512).alias("t"), F.lit("hot").alias("tenant_id"))
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="512k"):
        sinks.write_partitioned(hot, str(tmp_path / "hot"))
    assert len(glob.glob(f"{tmp_path}/hot/tenant_id=hot/*.parquet")) > 2
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 40_000


def test_bucketed_table_has_one_file_per_bucket_and_joins_without_a_shuffle(spark, namespace):
    df = spark.range(1000).select(F.col("id").alias("patient_id"), (F.col("id") % 7).alias("recorded_at"))
    sinks.write_bucketed(df, f"{namespace}.a", "patient_id", "recorded_at", buckets=4)
    sinks.write_bucketed(df, f"{namespace}.b", "patient_id", "recorded_at", buckets=4, file_bytes=2500)
    a, b = spark.table(f"{namespace}.a"), spark.table(f"{namespace}.b")
    assert len(a.inputFiles()) == 4 and len(b.inputFiles()) == 8
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        joined = a.join(b, "patient_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000


def test_hot_bucket_is_written_by_many_tasks(spark, namespace):
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k")
    df = spark.range(0, 20_000).select(key, F.sha2(F.col("id").cast("string"), 256).alias("h"))
    name = f"{namespace}.hot"
    sinks.write_bucketed(df, name, "k", "h", buckets=4, file_bytes=100_000)
    per_file = spark.table(name).groupBy("_metadata.file_path").count().collect()
    share = 100_000 // 72  # rows of a file: 8 bytes of key, 64 of text
    assert len(per_file) >= 14 and max(r["count"] for r in per_file) < 1.5 * share
    assert (spark.table(name).count(), spark.table(name).where("k = 7").count()) == (20_000, 10_001)
    with settings(spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false", spark__sql__maxMetadataStringLength="1000"):
        plan = spark.table(name).where("k = 7")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in plan
    sinks.write_bucketed(df.limit(0), f"{namespace}.none", "k", "h")
    assert spark.table(f"{namespace}.none").count() == 0


def test_month_filter_prunes_partitions(spark, namespace):
    days = spark.range(120).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit("eu").alias("region")
    )
    sinks.write_monthly(days, f"{namespace}.trends", "date", "region")
    wanted = sinks.month_filter("date", dt.date(2024, 2, 10), dt.date(2024, 3, 5))
    found = spark.table(f"{namespace}.trends").filter(wanted)
    assert found.count() == 25
    assert len(found.select("_metadata.file_path").distinct().collect()) == 2


def test_arrow_batches(spark):
    df = spark.range(0, 25_000, 1, 2).withColumn("t", F.col("id").cast("string"))
    batches = sinks.arrow_batches(df, chunk_size=10_000)
    sizes = [r.rows for r in batches.select("rows").collect()]
    assert sum(sizes) == 25_000 and max(sizes) <= 10_000
    total = 0
    for row in batches.toLocalIterator():
        with pa.ipc.open_stream(bytes(row.payload)) as reader:
            total += reader.read_all().num_rows
    assert total == 25_000
    assert sinks.arrow_batches(df, limit=7).agg(F.sum("rows")).first()[0] == 7


def test_strategy(spark, tmp_path):
    stamped = layout.stamp(spark.createDataFrame([(1, NOW)], "id int, ts timestamp_ntz"), "a", "csv", NOW)
    plan = layout.strategy(stamped)
    assert (plan.partition_by, plan.sort_by) == (["tenant_id", "day"], ["ingestion_timestamp"])
    assert layout.strategy(stamped, partitioning=False).partition_by == ["tenant_id"]
    sinks.write_arranged(stamped, str(tmp_path / "x"))
    assert glob.glob(f"{tmp_path}/x/tenant_id=a/day=2024-02-10/*.parquet")


@pytest.mark.parametrize("kind", ["table", "files"])
def test_ingest(spark, namespace, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "id int, name string")
    target = f"{namespace}.people" if kind == "table" else str(tmp_path / "load")
    read = spark.table if kind == "table" else spark.read.parquet
    done = load_and_model.ingest(df, target, "tenant_a", "csv", NOW, kind=kind)
    assert (done.records, done.batches, done.size_class, done.errors) == (4, 1, "small", 0)
    assert done.issues == ["1 repeated rows"] and done.bytes > 0 and done.seconds > 0
    assert set(read(target).columns) == {"id", "name", "tenant_id", "ingestion_timestamp", "source_type"}
    assert read(target).count() == 4
    # Loads of any size go to the same place.
    assert load_and_model.ingest(spark.range(1_000_001).select(F.col("id").cast("int"), F.lit("x").alias("name")), target, "tenant_a", "csv", NOW, None, kind).size_class == "large"
    assert read(target).count() == 1_000_005
    with pytest.raises(ValueError, match="unknown kind"):
        load_and_model.ingest(df, target, "a", "csv", kind="auto")


@pytest.mark.parametrize("kind", ["table", "files"])
def test_repeated_loads_replace_themselves(spark, namespace, tmp_path, kind):
    target = f"{namespace}.people" if kind == "table" else str(tmp_path / "load")
    read = spark.table if kind == "table" else spark.read.parquet
    for load, rows_ in (("a", 5), ("b", 3), ("a", 5), ("a", 4)):
        done = load_and_model.ingest(spark.range(rows_), target, "t", "csv", NOW, None, kind, load_id=load)
        assert (done.records, done.errors) == (rows_, 0)
    assert {r.load_id: r["count"] for r in read(target).groupBy("load_id").count().collect()} == {"a": 4, "b": 3}


def test_failed_writes_are_counted(spark, namespace):
    target = f"{namespace}.people"
    load_and_model.ingest(spark.range(2), target, "t", "csv", NOW, None)
    done = load_and_model.ingest(spark.createDataFrame([("x",)], "id string"), target, "t", "csv", NOW, None)
    assert (done.errors, done.records, done.batches) == (1, 0, 0) and "not written" in done.issues[-1]
    assert spark.table(target).count() == 2


def test_models_run_in_order(spark, small, namespace):
    names = load_and_model.run_models(spark, small.rev, namespace, "row_key", NOW)
    assert spark.table(names["mart_disease_analytics"]).count() == 5
    staged = spark.table(names["stg_healthcare_data"])
    ids = staged.agg(F.min("patient_id"), F.max("patient_id"), F.count_distinct("patient_id")).first()
    assert ids[:] == (1, staged.count(), staged.count())


def test_ingest_of_described_sources(spark, namespace, tmp_path):
    csv = tmp_path / "people.csv"
    csv.write_text("id;name\n1;Alice\n2;NA\n")
    config = {"type": "csv", "file_path": str(csv), "separator": ";"}
    done = load_and_model.ingest_source(spark, config, f"{namespace}.people", "a", NOW)
    assert done.records == 2
    assert rows(spark.table(f"{namespace}.people"), "id", "name", "source_type") == [(1, "Alice", "csv"), (2, None, "csv")]
    parquet = str(tmp_path / "p")
    spark.range(3).withColumn("x", F.col("id") * 2).write.parquet(parquet)
    config = {"type": "parquet", "file_path": parquet}
    done = load_and_model.ingest_source(spark, config, f"{namespace}.p", "a", NOW, None, columns=["x"])
    assert (done.records, spark.table(f"{namespace}.p").columns[0]) == (3, "x")
    with pytest.raises(RuntimeError, match="not found"):
        load_and_model.ingest_source(spark, {"type": "csv", "file_path": str(tmp_path / "no")}, "t", "a")


def test_uploads_append_or_replace_at_any_size(spark, namespace):
    registry, table = f"{namespace}.datasets", f"{namespace}.up"
    assert load_and_model.upload(spark.range(100_001), table, registry=registry, as_of=NOW) == "large"
    assert load_and_model.upload(spark.range(10), table, registry=registry, as_of=NOW) == "small"
    assert spark.table(table).count() == 100_011
    load_and_model.upload(spark.range(10), table, mode="replace")
    assert spark.table(table).count() == 10
    load_and_model.upload(spark.range(100_001), table, mode="replace")
    assert spark.table(table).count() == 100_001
    days = spark.range(2).select(F.lit(dt.date(2024, 1, 1)).alias("day"))
    load_and_model.upload(days, f"{namespace}.lake", sinks.LAKE)
    assert dict(spark.table(f"{namespace}.lake").dtypes) == {"day": "string"}
    assert rows(spark.table(registry), "tenant_id", "target", "rows") == [
        ("default-tenant", "local", 10), ("default-tenant", "local", 100_001),
    ]
    for bad in ({"target": "cloud"}, {"mode": "auto"}):
        with pytest.raises(ValueError, match="unknown"):
            load_and_model.upload(spark.range(1), table, **bad)


def test_tables_by_size_are_routed_by_rows_alone(small, monkeypatch):
    from lakeward.cases import load_all

    monkeypatch.setattr(layout, "LOAD_BYTES", 0)
    routed = load_all()["lay_by_size"].run(small).collect()
    assert len(routed) == 4
    assert {r.load_target for r in routed} == {"small"}


def test_a_large_load_of_one_tenant_is_written_by_many_tasks(spark, namespace):
    table = f"{namespace}.loads"
    rows = spark.range(400_000).select(F.col("id").cast("int"), F.lit("x").alias("name")).coalesce(1)
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="64k"):
        done = load_and_model.ingest(rows, table, "tenant_a", "csv", NOW, load_id="first")
    assert (done.records, done.errors) == (400_000, 0)
    written = spark.table(table).select(F.input_file_name().alias("f"))
    assert written.count() == 400_000
    assert written.distinct().count() > 1
