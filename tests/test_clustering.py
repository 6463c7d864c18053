from __future__ import annotations

import datetime as dt
import itertools

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.operators import clustering


@pytest.fixture(scope="module")
def visits(spark):
    """A third of the rows are of one tenant; every tenant is active all the time."""
    tenant = F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)))
    return spark.range(0, 60_000, 1, 4).select(
        "id", F.format_string("tenant_%03d", tenant.cast("int")).alias("tenant"),
        (F.lit(1_700_000_000) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(86_400 * 30))).cast("timestamp").alias("at"),
    )


def test_files_are_narrow_in_every_column(spark, visits, tmp_path):
    columns, paths = ["tenant", "at"], {n: str(tmp_path / n) for n in ("clustered", "sorted")}
    clustering.clustered(visits, columns, files=64).write.parquet(paths["clustered"])
    visits.repartitionByRange(64, *columns).write.parquet(paths["sorted"])
    frames = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert rows(frames["clustered"]) == rows(visits)
    middle = visits.select(F.min("at")).first()[0] + dt.timedelta(days=15)
    day = (middle, middle)
    # One tenant of 40, one moment of 30 days: an even split in both would open 8 of 64 files.
    tenant = clustering.share_read(frames["clustered"], columns, "tenant", "tenant_017", "tenant_017")
    moment = clustering.share_read(frames["clustered"], columns, "at", *day)
    assert tenant <= 0.3 and moment <= 0.3
    assert clustering.share_read(frames["sorted"], columns, "at", *day) > 2 * moment


def test_hot_values_are_split(spark, tmp_path):
    """One value in all columns fills many files; rows that are equal throughout stay together."""
    hot = spark.range(0, 20_000, 1, 4).select("id", F.lit("one").alias("tenant"), F.lit(1.0).alias("x"))
    path = str(tmp_path / "hot")
    clustering.clustered(hot, ["tenant", "x"], files=8).write.parquet(path)
    spans = clustering.file_spans(spark.read.parquet(path), ["tenant"]).collect()
    assert len(spans) == 8 and max(s["rows"] for s in spans) < 5_000


def test_odd_values_and_names(spark):
    df = spark.createDataFrame(
        [(None, None, None), (float("nan"), "", 1), (float("inf"), "x" * 5_000, 2), (-0.0, "é`", 3), (1.0, "b", 3)],
        "`a.b` double, `c``d` string, `_key` int",
    )
    out = clustering.clustered(df, ["a.b", "c`d", "_key"], files=3)
    assert out.columns == df.columns and repr(rows(out)) == repr(rows(df))  # NaN differs from itself
    assert clustering.clustered(df.limit(0), ["_key"]).collect() == []
    maps = df.withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert clustering.clustered(maps, ["_key"], files=2).count() == 5
    for wrong in ({"columns": []}, {"columns": ["_key"], "files": 0}, {"columns": ["_key"] * 11}):
        with pytest.raises(ValueError):
            clustering.clustered(df, **wrong)


def test_ranks_count_borders(spark):
    values = [None, -5, 0, 1, 2, 3, 99]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for size in range(5):
        cuts = [0, 1, 3, 50][:size]
        got = {r.v: r.rank for r in df.select("v", clustering.range_rank(F.col("v"), cuts).alias("rank")).collect()}
        assert got == {v: 0 if v is None else sum(c <= v for c in cuts) for v in values}


def test_bits_interleave_from_the_top(spark):
    pairs = list(itertools.product(range(4), range(2)))
    df = spark.createDataFrame(pairs, "a int, b int")
    key = clustering.interleaved([(F.col("a"), 3), (F.col("b"), 1)], bits=2)
    got = {(r.a, r.b): r.key for r in df.select("a", "b", key.alias("key")).collect()}
    # b has one bit, which stands beside the upper bit of a.
    assert got == {(a, b): (a >> 1) << 3 | b << 2 | (a & 1) << 1 for a, b in pairs}


def test_one_exchange(visits):
    plan = clustering.clustered(visits, ["tenant", "at"], files=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Window" not in plan
