from __future__ import annotations

import glob
import os

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.sources import arrow_files


def listed(path):
    return sorted(p for p in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(p))


def test_rows_come_back_and_appends_add(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.sql(
        "select id, cast(id as string) as s, if(id % 7 = 0, null, id / 2.0) as d, array(id, null) as a, "
        "struct(id as x, 'y' as y) as st, timestamp'2024-01-01' as t, date'2024-01-02' as day, cast(1.5 as decimal(9,2)) as m "
        "from range(0, 100, 1, 4)"
    )
    arrow_files.write(df, path, chunk_rows=7)
    back = arrow_files.read(spark, path)
    assert dict(back.dtypes) == dict(df.dtypes) and rows(back) == rows(df)
    assert len(listed(path)) == 4
    arrow_files.write(df, path)
    assert arrow_files.read(spark, path).count() == 200
    arrow_files.write(df.where("id < 3"), path, mode="overwrite")
    assert rows(arrow_files.read(spark, path)) == rows(df.where("id < 3"))
    with pytest.raises(ValueError, match="chunk_rows"):
        arrow_files.ArrowFiles({"path": path, "chunk_rows": "0"}).writer(df.schema, False)


def test_chunks_and_columns(spark, tmp_path):
    path = str(tmp_path / "out")
    arrow_files.write(spark.range(0, 25, 1, 1).withColumn("twice", F.col("id") * 2), path, chunk_rows=10)
    with pa.OSFile(listed(path)[0]) as source, pa.ipc.open_file(source) as file:
        assert [file.get_batch(k).num_rows for k in range(file.num_record_batches)] == [10, 10, 5]
    assert rows(arrow_files.read(spark, path, "twice bigint")) == sorted([(2 * i,) for i in range(25)], key=repr)


def test_empty_frames_and_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    arrow_files.write(spark.range(0), path)
    assert listed(path) == []
    assert arrow_files.read(spark, path, "id bigint").collect() == []
    with pytest.raises(Exception, match="give the schema"):
        arrow_files.read(spark, path).collect()


def test_nothing_of_a_failed_job_is_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    arrow_files.write(spark.range(0, 10, 1, 2), path)
    before = glob.glob(f"{path}/*.arrow")
    failing = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            arrow_files.write(failing, path, mode=mode)
        assert glob.glob(f"{path}/*.arrow") == before
    assert arrow_files.read(spark, path).count() == 10


def test_a_repeated_attempt_leaves_one_copy(tmp_path):
    """The steps of a task that dies after some rows and runs again, and one whose twin also ends."""
    path = str(tmp_path / "out")
    batches = [pa.RecordBatch.from_pydict({"id": [k, k + 1]}) for k in (0, 2)]
    writer = arrow_files.ArrowFilesWriter(path, 10, overwrite=False)

    def dies():
        yield batches[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    twin, done = writer.write(iter(batches)), writer.write(iter(batches))
    assert twin.name != done.name and done.rows == 4
    assert [p for p in listed(path) if "_temporary" not in p] == []  # nothing to see before the commit
    writer.commit([done, writer.write(iter([])), None])
    assert [os.path.basename(p) for p in listed(path)] == [done.name]
    other = arrow_files.ArrowFilesWriter(path, 10, overwrite=True)
    other.abort([other.write(iter(batches)), None])
    assert [os.path.basename(p) for p in listed(path)] == [done.name]
