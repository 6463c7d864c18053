"""Data-quality checks as whole-table queries.

Checks over the same rows share one aggregate; the scan is never repeated per
column. Checks that need a shuffle (uniqueness, repeated rows) count digests
and shuffle only rows whose digest recurs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakeward.functions import columns as c
from lakeward.operators.layout import row_bytes
from lakeward.session import stage

ROWS = "rows"


def column_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of a column."""
    return df.select(column).filter(c.present([column])).distinct().orderBy(F.col(column).asc_nulls_last())


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows where a required column is null."""
    return df.filter(F.col(column).isNull())


def repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Values (or combinations) seen more than once; a single null key is no value.

    Combinations and texts are counted by digest first (``recurring``), so that only
    those that recur are shuffled whole.
    """
    keys = df.select(*columns)
    keyed = keys.filter(c.present(columns)) if len(columns) == 1 else keys
    types = [f.dataType for f in keyed.schema.fields]
    # A number is no wider than its digest: counting it as it is takes one shuffle less.
    if len(types) > 1 or not isinstance(types[0], (T.NumericType, T.DatetimeType, T.BooleanType)):
        keyed = recurring(keyed)
    counted = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias(_TIMES)).filter(F.col(_TIMES) > 1)
    return counted.withColumnRenamed(_TIMES, "n")


_DIGEST, _AGAIN, _TIMES = "_digest", "_again", "_times"


def _digest(df: DataFrame) -> Column:
    """64-bit digest of a row: of its values, and of which of them are null.

    Rows that group as one have one digest: signs of zero and kinds of NaN do not
    matter to it either. Values that have no hash (maps) are left out, so rows that
    differ in these alone share a digest and are told apart by the comparison.
    """
    names = [f"`{f.name}`" for f in df.schema.fields if not _holds_map(f.dataType)]
    holes = [F.col(f"`{n}`").isNull() for n in df.columns]
    return F.xxhash64(*names, *holes)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def recurring(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that may occur more than once: all that do, and rarely others.

    A digest per row is counted, with a combine before the shuffle, so what crosses the
    network for a row that is there once is its digest alone. The digests seen more
    than once are staged, so Spark knows their size: it broadcasts them below
    ``autoBroadcastJoinThreshold`` and shuffles beyond it, where adaptive execution
    splits a digest that many rows share. The frame is computed twice.
    """
    again = df.select(_digest(df).alias(_AGAIN)).groupBy(_AGAIN).agg(F.count(F.lit(1)).alias("n"))
    again = stage(again.filter("n > 1").select(_AGAIN), "again")
    suspects = df.withColumn(_DIGEST, _digest(df)).join(again, F.col(_DIGEST) == F.col(_AGAIN), "left_semi")
    return suspects.drop(_DIGEST)


def unexpected_values(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values outside the list with their counts; nulls pass."""
    outside = df.filter(~F.col(column).isin(*accepted))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def outside_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies outside [low, high]; nulls pass."""
    return df.filter(~F.col(column).between(low, high))


def freshness(
    df: DataFrame,
    loaded_at: str,
    warn_after: dt.timedelta,
    error_after: dt.timedelta,
    as_of: dt.datetime,
) -> DataFrame:
    """Newest load time with ``pass``, ``warn`` or ``error`` by its age."""
    kind = df.schema[loaded_at].dataType
    newest = F.max(loaded_at)

    def older_than(age: dt.timedelta) -> Column:
        return newest < c.timestamp_literal(as_of - age, kind)

    # A table without a single load time is as stale as can be.
    status = (
        F.when(older_than(error_after) | newest.isNull(), "error")
        .when(older_than(warn_after), "warn")
        .otherwise("pass")
    )
    return df.agg(newest.alias("newest"), status.alias("status"))


def profile(df: DataFrame, expected: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Null and unexpected-value counts per column, from one pass.

    One row per column for nulls, and one more where accepted values are
    given; its percentage is over the non-null rows.
    """
    measures = [F.count(F.lit(1)).alias(ROWS)]
    for i, (name, accepted) in enumerate(expected.items()):
        column = F.col(f"`{name}`")
        measures.append(F.count(column).alias(f"filled_{i}"))
        if accepted:
            measures.append(F.count_if(~column.isin(*accepted)).alias(f"odd_{i}"))
    lines = []
    for i, (name, accepted) in enumerate(expected.items()):
        rows, filled = F.col(ROWS), F.col(f"filled_{i}")
        lines.append(_profile_line(name, "null_count", rows, rows - filled))
        if accepted:
            lines.append(_profile_line(name, "unexpected_values", filled, F.col(f"odd_{i}")))
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def _profile_line(name: str, test: str, rows: Column, found: Column) -> Column:
    return F.struct(
        F.lit(name).alias("column_name"),
        F.lit(test).alias("test_type"),
        rows.alias("total_rows"),
        found.alias("null_count"),
        c.percent(found, rows).alias("null_percentage"),
    )


def summary(models: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], all_models: bool = False) -> DataFrame:
    """Failure counts per model, one pass each; models without a failure are left out."""
    checks = list(dict.fromkeys(name for _, tests in models.values() for name in tests))
    parts = [
        df.agg(
            F.lit(model).alias("model_name"),
            F.count(F.lit(1)).alias("total_rows"),
            *[
                (F.count_if(tests[name]) if name in tests else F.lit(0).cast("bigint")).alias(name)
                for name in checks
            ],
        )
        for model, (df, tests) in models.items()
    ]
    united = reduce(DataFrame.unionByName, parts)
    if all_models:
        return united
    return united.filter(reduce(Column.__or__, [F.col(name) > 0 for name in checks]))


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value."""
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(df.columns)])
    lines = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("filled"))
        for i, n in enumerate(df.columns)
    ]
    listed = counts.select(F.inline(F.array(*lines)))
    return listed.filter("filled = 0").select("column_name")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of repeated rows: all but the first of each; null equals null.

    Only rows whose digest recurs are compared, and shuffled, whole. Rows without a
    column are all the same.
    """
    if not df.columns:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicate_rows"))
    groups = recurring(df).groupBy(*[F.col(f"`{n}`") for n in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


# Kinds a text value can have, tried in this order.
KINDS = ["int", "double", "date", "boolean", "text"]
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def value_kind(column: Column) -> Column:
    """What a text value looks like; null stays null."""
    text = F.trim(column)
    date = F.when(text.rlike(_DATE), text.try_cast("date"))
    return (
        F.when(column.isNull(), None)
        .when(text.rlike(c.WHOLE), "int")
        .when(text.rlike(c.NUMBER), "double")
        .when(date.isNotNull(), "date")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .otherwise("text")
    )


def mixed_columns(df: DataFrame) -> DataFrame:
    """Per text column the kinds its values have; more than one is ``mixed``."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, kinds array<string>, mixed boolean")
    # Each value is parsed once, then its kind is tested against the five names.
    kinds = df.select(*[value_kind(F.col(f"`{n}`")).alias(f"k{i}") for i, n in enumerate(names)])
    seen = kinds.agg(
        *[
            F.coalesce(F.bool_or(F.col(f"k{i}") == kind), F.lit(False)).alias(f"k{i}_{kind}")
            for i in range(len(names))
            for kind in KINDS
        ]
    )
    lines = []
    for i, name in enumerate(names):
        found = F.array_compact(F.array(*[F.when(F.col(f"k{i}_{k}"), k) for k in KINDS]))
        lines.append(
            F.struct(
                F.lit(name).alias("column_name"),
                found.alias("kinds"),
                (F.size(found) > 1).alias("mixed"),
            )
        )
    return seen.select(F.inline(F.array(*lines)))


@dataclass(frozen=True)
class Limits:
    """What a load may look like before it is reported."""

    max_bytes: int = 1024 * 1024 * 1024
    check_duplicates: bool = True
    check_mixed: bool = True
    ignore: Sequence[str] = field(default_factory=tuple)


def issues(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per issue: kind, column (null for the whole frame), figure, message.

    An empty frame is the only issue of itself. Every other figure but the
    duplicate count comes from the same pass.
    """
    found = _first_pass(df, limits).select(F.inline("found"))
    return found.unionByName(_repeats(df, limits)) if limits.check_duplicates else found


def _repeats(df: DataFrame, limits: Limits) -> DataFrame:
    names = [n for n in df.columns if n not in limits.ignore]
    again = F.col("duplicate_rows")
    text = F.concat(again.cast("string"), F.lit(" repeated rows"))
    line = _issue(again > 0, "duplicates", None, again, text)
    counted = duplicate_rows(df.select(*[f"`{n}`" for n in names]))
    return counted.select(F.inline(F.array_compact(F.array(line))))


def _first_pass(df: DataFrame, limits: Limits) -> DataFrame:
    """Rows, bytes and the issues one aggregate can find, in a single row."""
    names = [n for n in df.columns if n not in limits.ignore]
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)] if limits.check_mixed else []
    checked = df.select(
        *[F.col(f"`{n}`").isNotNull().alias(f"has_{i}") for i, n in enumerate(names)],
        *[value_kind(F.col(f"`{n}`")).alias(f"kind_{i}") for i, n in enumerate(texts)],
        row_bytes(df).alias("bytes"),
    )
    figures = checked.agg(
        F.count(F.lit(1)).alias(ROWS),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        *[F.count_if(f"has_{i}").alias(f"has_{i}") for i in range(len(names))],
        *[
            F.coalesce(F.bool_or(F.col(f"kind_{i}") == kind), F.lit(False)).alias(f"kind_{i}_{kind}")
            for i in range(len(texts))
            for kind in KINDS
        ],
    )
    some = F.col(ROWS) > 0
    lines = [_issue(~some, "empty", None, F.lit(0), F.lit("no rows"))]
    for i, name in enumerate(names):
        empty = some & (F.col(f"has_{i}") == 0)
        lines.append(_issue(empty, "all_null", name, F.col(ROWS), F.lit(f"column {name} holds only nulls")))
    for i, name in enumerate(texts):
        kinds = F.lit(0)
        for kind in KINDS:
            kinds = kinds + F.col(f"kind_{i}_{kind}").cast("int")
        lines.append(_issue(kinds > 1, "mixed", name, kinds, F.lit(f"column {name} mixes kinds of values")))
    size = F.col("bytes")
    lines.append(
        _issue(
            size > limits.max_bytes,
            "size",
            None,
            size,
            F.concat(size.cast("string"), F.lit(f" bytes, more than {limits.max_bytes}")),
        )
    )
    return figures.select(ROWS, "bytes", F.array_compact(F.array(*lines)).alias("found"))


def _issue(condition: Column, kind: str, name: str | None, figure: Column, message: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(kind).alias("issue"),
            F.lit(name).cast("string").alias("column_name"),
            figure.cast("bigint").alias("figure"),
            message.alias("message"),
        ),
    )


@dataclass(frozen=True)
class Report:
    """Size of a checked frame and the messages of its issues."""

    rows: int
    bytes: int
    messages: list[str]

    @property
    def ok(self) -> bool:
        return not self.messages


def validate(df: DataFrame, limits: Limits = Limits()) -> Report:
    """Check a frame; what reaches the driver is bounded by its columns."""
    first = _first_pass(df, limits).first()
    messages = [issue.message for issue in first.found]
    if limits.check_duplicates:
        messages += [issue.message for issue in _repeats(df, limits).collect()]
    return Report(first[ROWS], first["bytes"], messages)


class QualityError(ValueError):
    """A check with severity ``error`` found failures."""


def with_severity(checks: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Failures per check with its severity and result (``pass``, ``warn`` or ``error``)."""
    parts = [
        failures.agg(
            F.lit(name).alias("check_name"),
            F.lit(severity).alias("severity"),
            F.count(F.lit(1)).alias("failures"),
        )
        for name, (failures, severity) in checks.items()
    ]
    result = F.when(F.col("failures") > 0, F.col("severity")).otherwise("pass")
    return reduce(DataFrame.unionByName, parts).withColumn("result", result)


def enforce(results: DataFrame) -> None:
    """Raise when any check ended in ``error``; warnings pass."""
    failed = [row.check_name for row in results.filter("result = 'error'").collect()]
    if failed:
        raise QualityError("failed checks: " + ", ".join(sorted(failed)))


@dataclass(frozen=True)
class Check:
    """A declared expectation on one or more columns."""

    kind: str  # not_null, accepted_values, accepted_range or unique
    columns: tuple[str, ...]
    values: tuple = ()
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"{self.kind}_{'_'.join(self.columns)}"

    def broken(self) -> Column:
        """Rows that break a row-level check; nulls pass all but ``not_null``."""
        column = F.col(f"`{self.columns[0]}`")
        if self.kind == "not_null":
            return column.isNull()
        if self.kind == "accepted_values":
            return ~column.isin(*self.values)
        if self.kind == "accepted_range":
            return ~column.between(*self.values)
        raise ValueError(f"unknown check {self.kind!r}")


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Failures and result of every check.

    All row-level checks share one pass; each uniqueness check, which counts
    values or combinations seen more than once, has its own aggregate.
    """
    by_row = [check for check in checks if check.kind != "unique"]
    counted = df.agg(
        F.count(F.lit(1)).alias(ROWS),
        *[F.count_if(check.broken()).alias(f"c{i}") for i, check in enumerate(by_row)],
    )
    lines = [_check_line(check, F.col(f"c{i}")) for i, check in enumerate(by_row)]
    parts = [counted.select(F.inline(F.array(*lines)))] if lines else []
    for check in checks:
        if check.kind == "unique":
            seen = repeated(df, *check.columns).agg(F.count(F.lit(1)).alias("n"))
            parts.append(seen.select(F.inline(F.array(_check_line(check, F.col("n"))))))
    return reduce(DataFrame.unionByName, parts)


def _check_line(check: Check, failures: Column) -> Column:
    result = F.when(failures > 0, check.severity).otherwise("pass")
    return F.struct(
        F.lit(check.name).alias("check_name"),
        F.lit(check.severity).alias("severity"),
        failures.alias("failures"),
        result.alias("result"),
    )
