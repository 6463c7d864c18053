"""Encoding, banding, casting and date expressions used by models and checks.

Casts spell out their type so that a figure means the same in every engine:
bare decimals are doubles here, null order is always written, subscripts
count from one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def present(names: Sequence[str]) -> Column:
    """All named columns have a value.

    Written as a conjunction because, unlike ``dropna``, it reaches the
    Parquet scan.
    """
    first, *rest = [F.col(f"`{name}`").isNotNull() for name in names]
    for condition in rest:
        first = first & condition
    return first


def normalize(text: str | Column) -> Column:
    """Upper-case text without surrounding spaces."""
    return F.trim(F.upper(text))


def flag_exact(text: str | Column, yes: str = "Yes") -> Column:
    """1 where the text is exactly ``yes``, else 0 (null counts as 0)."""
    return F.when(_col(text) == yes, 1).otherwise(0)


def flag(text: str | Column, yes: str = "YES") -> Column:
    """1 where the normalized text is ``yes``, else 0."""
    return F.when(normalize(text) == yes, 1).otherwise(0)


def tristate(text: str | Column, positive: str, negative: str) -> Column:
    """1 for ``positive``, 0 for ``negative``, null for anything else."""
    return F.when(_col(text) == positive, 1).when(_col(text) == negative, 0)


def total(columns: Sequence[Column]) -> Column:
    """Row-wise sum of columns."""
    first, *rest = columns
    for column in rest:
        first = first + column
    return first


def band(value: str | Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first band whose upper limit lies above the value.

    A null value falls through to ``otherwise``.
    """
    value = _col(value)
    (limit, name), *rest = limits
    chosen = F.when(value < limit, name)
    for limit, name in rest:
        chosen = chosen.when(value < limit, name)
    return chosen.otherwise(otherwise)


def age_group(age: str | Column) -> Column:
    # The age bands.
    return band(age, [(18, "Child"), (65, "Adult")], "Senior")


def risk_band(percent: str | Column) -> Column:
    """Risk label of a percentage."""
    percent = _col(percent)
    # The risk limits.
    return (
        F.when(percent > 75, "High Risk")
        .when(percent > 50, "Medium Risk")
        .otherwise("Low Risk")
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals; null where the whole is zero."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.round(ratio * 100, 2)


def share_of_rows(condition: Column) -> Column:
    """Aggregate: percentage of rows where the condition holds."""
    return percent(F.count_if(condition), F.count(F.lit(1)))


def rounded_int(value: str | Column) -> Column:
    """Integer cast that rounds, where a plain cast would cut."""
    return F.round(_col(value)).cast("int")


# Text that can be a number. Parsing anything else throws and catches an
# exception per row, which costs ten times as much as the pattern.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


def lenient_bigint(text: str | Column) -> Column:
    """Whole number in a text; null for any other text."""
    text = _col(text)
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def lenient_double(text: str | Column) -> Column:
    """Number in a text; null for text that is no number."""
    text = _col(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def lenient_int(text: str | Column) -> Column:
    """Integer from text such as ``'3.7'``, rounded; null for text that is no number."""
    return F.round(lenient_double(text)).try_cast("int")


def concat_skip_nulls(*parts: str | Column) -> Column:
    return F.concat_ws("", *parts)


def day_of_week(when: str | Column) -> Column:
    """Day of week with Sunday as 0."""
    return (F.dayofweek(when) - 1).cast("bigint")


def pick(choices: Sequence[str], index: Column) -> Column:
    """Element of a literal list by a zero-based number, wrapping around."""
    array = F.array(*[F.lit(choice) for choice in choices])
    return F.element_at(array, (F.pmod(index, F.lit(len(choices))) + 1).cast("int"))


def seeded_number(row_id: str | Column, seed: int, salt: str = "") -> Column:
    """Repeatable number in [0, 2**32) that depends on the row and seed only.

    ``rand(seed)`` changes with the partitioning; this does not, so a retried
    or re-split task draws the same sample.
    """
    text = F.concat_ws(":", _col(row_id).cast("string"), F.lit(str(seed)), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def json_object(fields: Mapping[str, Column]) -> Column:
    """JSON text of an object, keeping members that are null."""
    members = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(members, {"ignoreNullFields": "false"})


def json_value(text: str | Column, member: str, data_type: str = "string") -> Column:
    """One member of a JSON object as a scalar; null where it is missing."""
    return F.get_json_object(_col(text), f"$.{member}").cast(data_type)


def merge_maps(older: str | Column, newer: str | Column) -> Column:
    """Union of two maps; the newer value wins (see ``mapKeyDedupPolicy``)."""
    return F.map_concat(older, newer)


def timestamp_literal(moment: dt.datetime, data_type: T.DataType) -> Column:
    """Literal of the column's own timestamp type.

    Comparing a zone-less column with a zoned literal would wrap the column in
    a cast and keep the filter from reaching the Parquet scan.
    """
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(data_type, T.DateType):
        return F.lit(moment.date())
    kind = "timestamp_ntz" if isinstance(data_type, T.TimestampNTZType) else "timestamp"
    return F.expr(f"{kind}'{text}'")


def moment(as_of: dt.datetime | None) -> Column:
    """The given time as a constant column, or the clock when none is given."""
    if as_of is None:
        return F.current_timestamp()
    return timestamp_literal(as_of, T.TimestampNTZType())


def trunc_to(unit: str, column: str, df: DataFrame) -> Column:
    """``date_trunc`` that keeps the column's own timestamp type."""
    return F.date_trunc(unit, column).cast(df.schema[column].dataType)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
