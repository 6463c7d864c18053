"""Column statistics that follow a table load by load.

What is kept per load (or per partition) can be merged: counts, low and high add
up, and distinct values are HyperLogLog sketches, whose union is the sketch of all
rows. So an append or a rewritten partition is read alone, and the statistics of the
whole table come from one small row per part. A part that is recorded again replaces
itself, so a repeated load changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeward.sources.tables import quoted

#: Base-2 logarithm of a sketch's registers: 4,096 of them, a standard error of 1.6 %.
REGISTERS = 12
#: Three standard errors of an estimate, as a share.
ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _sketched(column: Column, kind: T.DataType) -> Column:
    """A value in a type that sketches take; equal for equal values only."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return column
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return column.cast("int")
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # one zero
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(column))
    return column.cast("string")


def _measured(df: DataFrame, parts: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in parts]


def partial_statistics(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """One mergeable row per combination of ``parts`` (one in all without any), in one pass.

    ``rows``, and for the i-th other column ``filled<i>``, ``sketch<i>`` and, where it has
    an order, ``low<i>`` and ``high<i>`` in the column's own type. Combined before the
    shuffle, so a hot part sends one row per task.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(_measured(df, parts)):
        column = F.col(quoted(f.name))
        value = _sketched(column, f.dataType)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.when(column.isNotNull(), value)
        measures += [F.count(column).alias(f"filled{i}"), F.hll_sketch_agg(value, F.lit(REGISTERS)).alias(f"sketch{i}")]
        if isinstance(f.dataType, _ORDERED):
            bound = column + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else column
            measures += [F.min(bound).alias(f"low{i}"), F.max(bound).alias(f"high{i}")]
    keys = [F.col(quoted(p)) for p in parts]
    return df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)


def merged(partials: DataFrame, schema: T.StructType, parts: Sequence[str] = ()) -> DataFrame:
    """Statistics per column over all rows of ``partials``, and a line with the row count.

    ``schema`` is that of the measured table, ``parts`` its columns that name parts. The
    lines are those of ``catalog.statistics``: null share, distinct values (an estimate),
    low and high as text; the line without a column name has the row count. Without a
    row every share is null and every count 0.
    """
    fields = [f for f in schema.fields if f.name not in parts]
    measures = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    for i, f in enumerate(fields):
        union = F.hll_sketch_estimate(F.hll_union_agg(f"sketch{i}"))
        measures += [F.sum(f"filled{i}").alias(f"filled{i}"), F.coalesce(union, F.lit(0)).alias(f"distinct{i}")]
        if isinstance(f.dataType, _ORDERED):
            measures += [F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}")]

    def line(name: str | None, nulls: Column, distinct: Column, low: Column, high: Column, rows: Column) -> Column:
        return F.struct(
            F.lit(name).cast("string").alias("column_name"),
            nulls.cast("double").alias("null_share"),
            distinct.cast("bigint").alias("distinct_values"),
            low.cast("string").alias("low_value"),
            high.cast("string").alias("high_value"),
            rows.cast("bigint").alias("row_count"),
        )

    none, lines = F.lit(None), []
    for i, f in enumerate(fields):
        has_order = isinstance(f.dataType, _ORDERED)
        nulls = F.try_divide(F.col("rows") - F.col(f"filled{i}"), F.col("rows").cast("double"))
        low, high = (F.col(f"low{i}"), F.col(f"high{i}")) if has_order else (none, none)
        lines.append(line(f.name, nulls, F.col(f"distinct{i}"), low, high, none))
    lines.append(line(None, none, none, none, none, F.col("rows")))
    return partials.agg(*measures).select(F.inline(F.array(*lines)))


def record_load(df: DataFrame, path: str, load_id: str) -> None:
    """Measure the rows of one load and keep the result below ``path``; a repeated load replaces itself."""
    if "_load_id" in df.columns:
        raise ValueError("_load_id names the loads; rename that column")
    loaded = partial_statistics(df).withColumn("_load_id", F.lit(load_id))
    _replace(loaded, path, ["_load_id"])


def record_partitions(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Measure the given rows by partition and keep a row per partition below ``path``.

    Give it the rows of new or changed partitions, all of each: their rows replace
    those kept before, and no other partition is read or written.
    """
    _replace(partial_statistics(df, parts), path, parts)


def _replace(partials: DataFrame, path: str, parts: Sequence[str]) -> None:
    # A row per part: as few files as adaptive execution makes of them.
    few = partials.hint("rebalance", *[F.col(quoted(p)) for p in parts])
    writer = few.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def recorded(spark: SparkSession, path: str, schema: T.StructType, parts: Sequence[str] = ()) -> DataFrame:
    """Statistics of everything recorded below ``path``; the table itself is not read."""
    return merged(spark.read.parquet(path), schema, parts)


def within_error(estimate: Column, exact: Column) -> Column:
    """Whether an estimate lies within three standard errors, or one value, of the exact number."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1), F.ceil(F.lit(ERROR) * exact))
