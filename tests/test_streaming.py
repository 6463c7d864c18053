from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lakeward.plans import models as m
from lakeward.session import fresh_path, release, shared_root, stage
from lakeward.sources import files
from lakeward.streaming import ingest, mview

NOW = dt.datetime(2024, 2, 10)


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("arriving", "target", "progress")]


def test_batches_are_bounded_and_a_restart_adds_nothing(spark, small, folders):
    arriving, target, checkpoint = folders
    small.events.repartition(5).write.parquet(arriving)
    stream = ingest.file_stream(spark, arriving, small.events.schema, max_files=2)
    first = ingest.ingest(stream, target, checkpoint, "a", "parquet", NOW)
    assert (first.batches, first.records, first.issues) == (3, small.events.count(), [])
    assert ingest.ingest(stream, target, checkpoint, "a", "parquet", NOW).batches == 0
    done = ingest.ingested(spark, target)
    assert done.count() == small.events.count()
    assert ingest.batches(spark, target).count() == 3
    small.events.limit(10).coalesce(1).write.mode("append").parquet(arriving)
    again = small.events.limit(1)
    again.union(again).coalesce(1).write.mode("append").parquet(arriving)
    second = ingest.ingest(stream, target, checkpoint, "a", "parquet", NOW)
    assert (second.batches, second.records) == (1, 12)
    assert any("repeated rows" in issue for issue in second.issues)
    assert ingest.ingested(spark, target).count() == small.events.count() + 12


def test_a_failed_batch_is_retried_without_a_second_copy(spark, small, folders):
    arriving, target, checkpoint = folders
    small.events.repartition(4).write.parquet(arriving)
    stream = ingest.file_stream(spark, arriving, small.events.schema, max_files=2)

    def fail_on_second(batch, batch_id):
        if batch_id == 1:
            # Half-done work of a lost driver: the batch's files exist already.
            batch.limit(3).write.parquet(f"{target}/batch_id=1")
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ingest.ingest(stream, target, checkpoint, "a", "parquet", NOW, before_write=fail_on_second)
    ingest.ingest(stream, target, checkpoint, "a", "parquet", NOW)
    done = ingest.ingested(spark, target)
    assert done.count() == small.events.count()
    assert done.select("event_id").distinct().count() == small.events.count()


def test_maintained_view_equals_the_full_query(spark, small, folders):
    arriving, target, checkpoint = folders
    small.patient_data.repartition(3).write.parquet(arriving)
    stream = ingest.file_stream(spark, arriving, small.patient_data.schema, max_files=1)
    mview.refresh(stream, target, checkpoint)
    full = m.patient_daily(small.patient_data, dt.datetime(2024, 2, 10), days=3650)
    columns = ["disease", "recorded_date", "total_cases", "positivity_rate", "avg_age"]
    assert rows(mview.current(spark, target), *columns) == rows(full, *columns)


def test_staged_results_survive_and_are_released(spark):
    df = stage(spark.range(10).withColumn("r", F.rand()))
    assert rows(df) == rows(df)  # written once, not recomputed
    path = fresh_path(spark, "x")
    assert path.startswith(shared_root(spark))
    assert release(spark) >= 1


class _Cluster:
    """Just enough of a session: a cluster master and its settings."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "yarn", "applicationId": "x"})()


def test_the_shared_folder_is_the_cluster_s_own():
    assert shared_root(_Cluster("hdfs://shared/folder/")) == "hdfs://shared/folder"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(_Cluster(None))


def test_csv_chunks_are_read_like_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,name\n1,"a ""b"""\nNA,null\n3,\n')
    schema = "id int, name string"
    stream = ingest.csv_stream(spark, str(tmp_path / "in"), schema)
    done = ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "a", "csv", NOW)
    batch = files.read_csv(spark, str(tmp_path / "in"), schema)
    assert rows(ingest.ingested(spark, str(tmp_path / "out")), "id", "name") == rows(batch) == sorted([(1, 'a "b"'), (None, None), (3, None)], key=repr)
    assert (done.records, done.errors) == (3, 0)
    (tmp_path / "in" / "b.csv").write_text("id,name\noops,x\n")
    with pytest.raises(Exception, match="id is not int: oops"):
        files.read_csv(spark, str(tmp_path / "in"), schema).collect()
    with pytest.raises(Exception, match="id is not int: oops"):
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "a", "csv", NOW)
    assert ingest.ingested(spark, str(tmp_path / "out")).count() == 3


def test_folded_figures_stay_the_same(spark, small, tmp_path):
    target = str(tmp_path / "figures")
    for n in range(3):
        part = small.patient_data.where(f"pmod(hash(patient_id), 3) = {n}")
        mview.partial_figures(part).write.parquet(f"{target}/batch_id={n}")
    before = rows(mview.current(spark, target))
    assert mview.fold(spark, target) == 3
    assert rows(mview.current(spark, target)) == before
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 1
    assert mview.fold(spark, target) == 0
