"""Numbering, ranking and running sums: hot keys, ties, nulls, range borders."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import rows, settings
from hypothesis import HealthCheck, given, settings as hypothesis_settings, strategies as st
from pyspark.sql import Window, functions as F

from lakeward.operators import joins, ranking

pytestmark = pytest.mark.usefixtures("many_ranges")


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows; one key holds most of them, one is null, values repeat."""
    data = []
    for i in range(900):
        key = "hot" if i % 3 else (None if i % 7 == 0 else f"k{i % 11}")
        value = None if i % 13 == 0 else i % 10
        data.append((i, key, value))
    return spark.createDataFrame(data, "id long, key string, value int").repartition(6)


def frame(df) -> pd.DataFrame:
    pdf = pd.DataFrame([r.asDict() for r in df.collect()])
    pdf["key"] = pdf["key"].map(lambda k: "~null" if k is None else k)
    return pdf


def test_rows_are_spread_over_ranges(skewed):
    order = [F.col("key").asc_nulls_last(), F.col("id")]
    assert ranking._placed(skewed, order).select("_range").distinct().count() > 2


def test_number_rows_equals_a_window(skewed):
    order = [F.col("key").asc_nulls_last(), F.col("value").desc_nulls_last(), F.col("id")]
    found = ranking.number_rows(skewed, order, "n")
    expected = sorted(
        (r.asDict() for r in skewed.collect()),
        key=lambda r: (r["key"] is None, r["key"] or "", r["value"] is None, -(r["value"] or 0), r["id"]),
    )
    assert rows(found, "id", "n") == sorted(
        ((r["id"], i + 1) for i, r in enumerate(expected)), key=repr
    )


def test_number_within_a_hot_key(skewed):
    found = frame(ranking.number_within(skewed, ["key"], [F.col("id")], "n"))
    expected = found.sort_values("id").groupby("key").cumcount() + 1
    assert (found["n"] == expected.reindex(found.index)).all()


def test_running_sum_over_range_borders(skewed):
    found = frame(ranking.running_sum(skewed, ["key"], [F.col("id")], F.col("id"), "before"))
    ordered = found.sort_values("id")
    expected = ordered.groupby("key")["id"].cumsum() - ordered["id"]
    assert (found["before"] == expected.reindex(found.index)).all()


@pytest.mark.parametrize("descending", [False, True])
def test_rank_with_ties_and_nulls(skewed, descending):
    found = frame(ranking.rank_within(skewed, ["key"], "value", "r", descending))
    expected = found.groupby("key")["value"].rank(
        method="min", ascending=not descending, na_option="bottom"
    )
    assert len(found) == 900
    assert (found["r"] == expected).all()


def test_top_per_key_is_exact(skewed):
    order = [F.col("value").desc_nulls_last(), F.col("id")]
    found = frame(ranking.top_per_key(skewed, ["key"], order, 7, salts=4))
    everything = frame(skewed)
    ordered = everything.sort_values(["value", "id"], ascending=[False, True], na_position="last")
    expected = ordered.groupby("key").head(7)
    assert sorted(found["id"]) == sorted(expected["id"])


def test_top_rows_of_a_whole_frame(skewed):
    order = [F.col("value").desc_nulls_last(), F.col("id")]
    found = ranking.top_rows(skewed, order, 25, salts=3)
    assert [r.id for r in found.collect()] == [r.id for r in skewed.orderBy(*order).limit(25).collect()]


def test_limit_is_pushed_below_the_shuffle(skewed):
    top = ranking.top_per_key(skewed, ["key"], [F.col("id")], 7)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # partial and final, in both rounds


def test_a_hot_join_key_is_split(spark):
    hot = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"),
        F.sha2(F.col("id").cast("string"), 512).alias("t"),
    )
    sides = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="256k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="512k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        joined = joins.join_summary(hot, sides, "k").groupBy("n").agg(
            F.count(F.lit(1)).alias("rows"), F.max("t").alias("t")
        )
        found = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert sum(r.rows for r in found) == 60_000


def test_array_chunks_keep_every_value(skewed):
    chunks = ranking.array_chunks(skewed, ["key"], "value", "id", "members", chunk_size=50)
    collected = chunks.collect()
    assert max(len(r.members) for r in collected) == 50
    for key in {r.key for r in collected}:
        joined = [v for r in sorted((r for r in collected if r.key == key), key=lambda r: r.chunk) for v in r.members]
        wanted = [r.value for r in skewed.collect() if r.key == key]
        assert joined == sorted(wanted, key=lambda v: (v is None, v or 0))


def test_group_totals_keep_null_keys(skewed):
    found = frame(joins.with_group_totals(skewed, ["key"], F.count(F.lit(1)).alias("n")))
    assert (found["n"] == found.groupby("key")["id"].transform("size")).all()
    assert len(found) == 900


ORDERS = {
    "by_n": [("n", True), ("key", False)],
    "by_s": [("s", False), ("key", True)],
    "by_key": [("key", False)],
}


def sorted_by(order):
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c, descending in order]


def test_ranks_of_a_result(skewed):
    metrics = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    plain = metrics
    for name, order in ORDERS.items():
        plain = plain.withColumn(name, F.row_number().over(Window.orderBy(*sorted_by(order))).cast("bigint"))
    assert rows(ranking.add_ranks(metrics, ORDERS)) == rows(plain)
    assert rows(ranking.add_ranks(metrics, {})) == rows(metrics)


def test_ranks_of_many_rows_share_one_range_exchange(skewed):
    """Orders over all rows, with nulls and ties, in several ranges each."""
    data = skewed.withColumnRenamed("value", "a b")
    orders = {
        "first": [("a b", True), ("id", False)],
        "second": [("key", False), ("a b", False), ("id", True)],
        "third": [("id", True)],
    }
    plain = data
    for name, order in orders.items():
        quoted = sorted_by([(f"`{c}`", d) for c, d in order])
        plain = plain.withColumn(name, F.row_number().over(Window.orderBy(*quoted)).cast("bigint"))
    found = ranking.add_ranks(data, orders)
    assert found.columns == [*data.columns, *orders] and rows(found) == rows(plain)
    plan = found._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan  # that exchange is done and written: what is left joins by row
    assert "CartesianProduct" not in plan


def test_ranks_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, n long, s long")
    assert ranking.add_ranks(empty, ORDERS).count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, key string, value int")
    assert ranking.number_rows(empty, [F.col("id")], "n").count() == 0
    assert ranking.rank_within(empty, ["key"], "value", "r").count() == 0


@hypothesis_settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    data=st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 3))),
        min_size=1,
        max_size=40,
    )
)
def test_rank_property(spark, data):
    numbered = [(i, key, value) for i, (key, value) in enumerate(data)]
    df = spark.createDataFrame(numbered, "id long, key string, value int")
    found = {r.id: r.r for r in ranking.rank_within(df, ["key"], "value", "r").collect()}
    for i, key, value in numbered:
        same = [v for _, k, v in numbered if k == key]
        better = [v for v in same if (v is not None and (value is None or v < value))]
        assert found[i] == len(better) + 1
