"""Materialized views that follow changes of their table, partition by partition.

A view is declared by its keys and by sums over the rows of a key; counts are sums of
ones, shares and means are quotients of sums, taken when the view is read. Such sums
can be added and subtracted, so a refresh reads the partitions of the table that
changed since the last one and nothing else: their old sums are subtracted from the
view, their new ones added. Appends, updates, deletes and dropped partitions are all
the same to it.

Below the view's folder every refresh has folders of its own, numbered from 1:

* ``sums``: the sums of the partitions that it read, by partition and key;
* ``totals``: the view after it, by key;
* ``index``: for every partition the state of its files and the refresh that read it
  last. It is written last, as one file, and makes the refresh count.

A refresh that fails leaves folders that no index names; its repetition writes them
again from the same starting point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeward.operators.ranking import join_null_safe
from lakeward.session import stage
from lakeward.sources.tables import quoted

ROWS = "_rows"
_STATE, _REFRESH = "_state", "_refresh"
_EXACT = (T.IntegralType, T.DecimalType)


@dataclass(frozen=True)
class View:
    """Keys and sums of a view, and what is shown of them (all sums by default).

    Sums are of whole numbers or decimals: floating point would leave
    rests when it is subtracted again. ``_rows`` is the number of rows of a key.
    """

    keys: Mapping[str, Column]
    sums: Mapping[str, Column]
    shown: Mapping[str, Column] = field(default_factory=dict)

    def added(self, rows: DataFrame, parts: Sequence[str]) -> DataFrame:
        """Sums per part and key, combined before the shuffle; sums are 0 where nothing was summed."""
        summed = {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in self.sums.items()}
        found = rows.groupBy(*[F.col(quoted(p)) for p in parts], *[c.alias(n) for n, c in self.keys.items()]).agg(
            *[c.alias(n) for n, c in summed.items()], F.count(F.lit(1)).alias(ROWS)
        )
        for f in found.schema.fields:
            if f.name in self.sums and not isinstance(f.dataType, _EXACT):
                raise ValueError(f"{f.name} is summed as {f.dataType.simpleString()}: cast it to a decimal or whole number")
        return found

    def combined(self, signed: DataFrame) -> DataFrame:
        """Sums per key over rows of sums; keys without a row left are gone."""
        names = [*self.sums, ROWS]
        types = {f.name: f.dataType for f in signed.schema.fields}
        total = signed.groupBy(*[F.col(quoted(k)) for k in self.keys]).agg(
            *[F.sum(quoted(n)).cast(types[n]).alias(n) for n in names]
        )
        return total.where(F.col(ROWS) != 0)


def file_states(source: DataFrame, parts: Sequence[str]) -> DataFrame:
    """A digest of the files (name, size, time) of every partition; reads no column of the table."""
    meta = F.col("_metadata")
    files = source.select(
        *[F.col(quoted(p)) for p in parts],
        F.xxhash64(meta["file_path"], meta["file_size"], meta["file_modification_time"]).alias("_file"),
    ).distinct()
    return files.groupBy(*parts).agg(F.sum(F.col("_file").cast("decimal(38,0)")).alias(_STATE), F.count(F.lit(1)).alias("_files"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def last_refresh(spark: SparkSession, path: str) -> int:
    """Number of the last refresh that is complete; 0 before the first."""
    index = _read(spark, f"{path}/index")
    return 0 if index is None else index.agg(F.max(_REFRESH)).first()[0]


def _in(source: DataFrame, parts: Sequence[str], touched: Sequence[tuple]) -> DataFrame:
    """The rows of some partitions, by a filter that prunes the others from the scan.

    One condition per partition; their values are metadata of the table's folders.
    """
    alike = [
        reduce(Column.__and__, [F.col(quoted(p)).eqNullSafe(F.lit(v)) for p, v in zip(parts, values)]) for values in touched
    ]
    return source.where(reduce(Column.__or__, alike) if alike else F.lit(False))


def changed_partitions(source: DataFrame, path: str, parts: Sequence[str]) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """States of all partitions, and those that are new or changed, and those that are gone, since the last refresh."""
    spark = source.sparkSession
    now = stage(file_states(source, parts), "states")
    last = last_refresh(spark, path)
    if not last:
        return now, [tuple(r)[:-2] for r in now.collect()], []
    before = spark.read.parquet(f"{path}/index").where(F.col(_REFRESH) == last).select(
        *parts, F.col(_STATE).alias("_old"), F.col("_files").alias("_old_files")
    )
    both = join_null_safe(now.withColumn("_here", F.lit(True)), before, list(parts), "left")
    same = F.col("_old").eqNullSafe(F.col(_STATE)) & F.col("_old_files").eqNullSafe(F.col("_files"))
    changed = [tuple(r) for r in both.where(~same).select(*parts).collect()]
    gone = join_null_safe(before, now, list(parts), "left_anti")
    return now, changed, [tuple(r) for r in gone.select(*parts).collect()]


def refresh(source: DataFrame, view: View, path: str, parts: Sequence[str]) -> int:
    """Bring the view below ``path`` up to date with ``source``; how many partitions were read or dropped.

    ``source`` reads a table of files partitioned by ``parts``, and must be read anew
    for each refresh. Without a change nothing is written.
    """
    spark, parts = source.sparkSession, list(parts)
    now, changed, gone = changed_partitions(source, path, parts)
    last = last_refresh(spark, path)
    if last and not changed and not gone:
        return 0
    this = last + 1
    view.added(_in(source, parts, changed), parts).write.mode("overwrite").parquet(f"{path}/sums/{_REFRESH}={this}")
    signed = spark.read.parquet(f"{path}/sums/{_REFRESH}={this}").drop(*parts)
    columns = [*view.keys, *view.sums, ROWS]
    if last:
        names = [*view.sums, ROWS]
        # The old sums of what changed lie in the refresh that the index names.
        index = spark.read.parquet(f"{path}/index").where(F.col(_REFRESH) == last).drop(_REFRESH)
        index = _in(index, parts, [*changed, *gone]).select(*parts, F.col("_read_by").alias(_REFRESH))
        old = join_null_safe(_in(spark.read.parquet(f"{path}/sums"), parts, [*changed, *gone]), index, [*parts, _REFRESH], "left_semi")
        old = old.select(*view.keys, *[(-F.col(quoted(n))).alias(n) for n in names])
        totals = spark.read.parquet(f"{path}/totals/{_REFRESH}={last}")
        signed = reduce(DataFrame.unionByName, [f.select(*[quoted(c) for c in columns]) for f in (totals, signed, old)])
    view.combined(signed).write.mode("overwrite").parquet(f"{path}/totals/{_REFRESH}={this}")

    read_by = F.lit(this)
    if last:
        index = spark.read.parquet(f"{path}/index").where(F.col(_REFRESH) == last)
        index = index.select(*parts, F.col("_read_by").alias("_by"), F.col(_STATE).alias("_old"), F.col("_files").alias("_old_files"))
        known = join_null_safe(now, index, parts, "left")
        same = F.col("_old").eqNullSafe(F.col(_STATE)) & F.col("_old_files").eqNullSafe(F.col("_files"))
        now = known.withColumn("_read_by", F.when(same, F.col("_by")).otherwise(read_by)).drop("_by", "_old", "_old_files")
    else:
        now = now.withColumn("_read_by", read_by)
    # A row per partition of the table, in one file: it is there as a whole or not at all.
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{_REFRESH}={this}")
    return len(changed) + len(gone)


def current(spark: SparkSession, view: View, path: str) -> DataFrame:
    """The view's rows after the last complete refresh."""
    last = last_refresh(spark, path)
    if not last:
        raise ValueError(f"nothing was refreshed below {path}")
    totals = spark.read.parquet(f"{path}/totals/{_REFRESH}={last}")
    shown = view.shown or {n: F.col(quoted(n)) for n in view.sums}
    return totals.select(*[quoted(k) for k in view.keys], *[c.alias(n) for n, c in shown.items()])
