"""Row numbers, ranks and running sums without a one-task window.

A window with no partition key, or with a key that holds a third of the rows,
sorts all of it in one task. Here the rows are range-partitioned on the full
sort order (key, value and a unique tie-break, so a hot key spreads over many
ranges), written once, and numbered per range; only one small row per range is
combined globally.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeward.session import stage

# monotonically_increasing_id() keeps the partition in the upper bits and the
# position inside the partition in the lower 33.
_POSITION_BITS = 33
_PLACE, _RANGE, _ROW, _ORDER = "_place", "_range", "_row", "_order"


def _placed(df: DataFrame, order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """Rows staged in global order with their range and place in it."""
    keep = df.columns if keep is None else keep
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*keep, F.monotonically_increasing_id().alias(_PLACE))
    )
    return stage(ranged, "ranges").withColumn(
        _RANGE, F.shiftright(_PLACE, _POSITION_BITS)
    )


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """``row_number() over (order by ...)`` from 1, in two distributed passes.

    The order must be total: end it with a unique column. ``keep`` names the
    columns wanted in the result; the others only serve the sort and are not
    written.
    """
    keep = df.columns if keep is None else list(keep)
    placed = _placed(df, order, keep)
    in_order = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so both this window and the broadcast are bounded by
    # the number of shuffle partitions, not by the data.
    starts = (
        placed.groupBy(_RANGE)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(_RANGE, F.coalesce(F.sum("_rows").over(in_order), F.lit(0)).alias("_start"))
    )
    position = F.col(_PLACE).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return placed.join(F.broadcast(starts), _RANGE).select(
        *keep, (F.col("_start") + position + 1).alias(name)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Sum of ``value`` over the rows of the same key that come earlier (0 for the first).

    Each window runs inside one range of one key. A key cut by range borders
    gets the sum of its earlier pieces added.
    """
    placed = _placed(
        df.withColumn("_value", value), [*[F.col(k).asc_nulls_last() for k in keys], *order]
    )
    earlier_in_range = (
        Window.partitionBy(_RANGE, *keys)
        .orderBy(_PLACE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_pieces = (
        Window.partitionBy(*keys)
        .orderBy(_RANGE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A range continues at most one key (its first), so at most one row per
    # range survives the filter; that bounds the broadcast.
    carried = (
        placed.groupBy(_RANGE, *keys)
        .agg(F.sum("_value").alias("_piece"))
        .withColumn("_carry", F.sum("_piece").over(earlier_pieces))
        .filter(F.col("_carry").isNotNull())
        .select(F.col(_RANGE).alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
    )
    same = F.col(_RANGE) == F.col("_r")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    zero = F.lit(0)
    return (
        placed.withColumn("_inside", F.sum("_value").over(earlier_in_range))
        .join(F.broadcast(carried), same, "left")
        .select(
            *df.columns,
            (F.coalesce("_carry", zero) + F.coalesce("_inside", zero)).alias(name),
        )
    )


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number() over (partition by keys order by ...)``; the order must be total.

    The rows of a key are neighbours in their range, so a row's number follows
    from its place, the first place of its key there, and the key's rows in
    earlier ranges. One row per key and range is joined back; the data itself
    is not shuffled again while those rows are small enough to broadcast.
    """
    placed = _placed(df, [*[F.col(k).asc_nulls_last() for k in keys], *order])
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy(_RANGE, *keys)
        .agg(F.min(_PLACE).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    numbered = join_null_safe(placed, stage(pieces, "pieces"), [_RANGE, *keys], "inner")
    number = F.col(_PLACE) - F.col("_first") + F.col("_before") + 1
    return numbered.select(*df.columns, number.alias(name))


def rank_within(
    df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = False
) -> DataFrame:
    """``rank() over (partition by keys order by value)``, nulls last.

    Equal values are counted before the shuffle, so neither a hot key nor a
    hot value gathers its rows; the ranked values are joined back.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ranked = running_sum(counts, keys, [order], F.col("_ties"), name)
    ranked = stage(ranked.withColumn(name, F.col(name) + 1).drop("_ties"), "ranks")
    return join_null_safe(df, ranked, [*keys, value], "inner")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys where null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{i}"))
    joined = left.join(renamed, same, how)
    return joined.drop(*[f"_right_{i}" for i in range(len(keys))])


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, salts: int = 64
) -> DataFrame:
    """The first ``count`` rows of every key, exactly.

    Two rounds: first per key and group of input partitions, then per key over
    the survivors. Spark pushes the row limit below both exchanges (up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a task sends at
    most ``count`` rows per key; a hot key is spread over ``salts`` tasks and
    its last task sees at most ``salts * count`` rows.
    """
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        _top_per_salt(df, keys, order, count, salts)
        .withColumn("_n", F.row_number().over(last))
        .filter(F.col("_n") <= count)
        .drop("_n")
    )


def top_rows(df: DataFrame, order: Sequence[Column], count: int, salts: int = 64) -> DataFrame:
    """The first ``count`` rows of the whole frame, exactly.

    ``orderBy().limit()`` alone sends ``count`` rows of every input task to
    one task; here only ``salts * count`` arrive there.
    """
    return _top_per_salt(df, [], order, count, salts).orderBy(*order).limit(count)


def _top_per_salt(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, salts: int
) -> DataFrame:
    # Salting by input partition, not by row, keeps a task from sending one
    # limit per salt.
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    window = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        salted.withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= count)
        .drop("_n", "_salt")
    )


def add_ranks(df: DataFrame, ranks: Mapping[str, Sequence[tuple[str, bool]]]) -> DataFrame:
    """Several independent ``row_number() over (order by ...)`` on one result, in one pass.

    An order is a list of ``(column, descending)``, nulls last, and must be total.
    The result is staged under row numbers of its own; every row then goes once per
    order, with the columns of that order alone, into one range exchange over
    ``(order, its columns)``. So all orders are sampled, sorted and numbered together,
    no order is a task of its own, and the other columns stay where they are. The
    numbers come back grouped by row.
    """
    if not ranks:
        return df
    rows = stage(df.withColumn(_ROW, F.monotonically_increasing_id()), "ranked")
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [(k, column, descending) for k, order in enumerate(ranks.values()) for column, descending in order]
    copies = [
        F.struct(
            F.lit(own).alias(_ORDER),
            *[
                (F.col(f"`{column}`") if k == own else F.lit(None).cast(types[column])).alias(f"_s{i}")
                for i, (k, column, _) in enumerate(fields)
            ],
        )
        for own in range(len(ranks))
    ]
    # Columns of another order are null in all rows of an order: they change nothing.
    sort = [F.col(_ORDER), *[
        F.col(f"_s{i}").desc_nulls_last() if descending else F.col(f"_s{i}").asc_nulls_last()
        for i, (_, _, descending) in enumerate(fields)
    ]]
    placed = _placed(rows.select(_ROW, F.inline(F.array(*copies))), sort, [_ROW, _ORDER])
    earlier = Window.partitionBy(_ORDER).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and order; ranges cut orders, so there are at most as many
    # as shuffle partitions and orders together, and that bounds the broadcast.
    starts = (
        placed.groupBy(_ORDER, _RANGE)
        .agg(F.min(_PLACE).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    number = F.col(_PLACE) - F.col("_first") + F.col("_before") + 1
    numbered = placed.join(F.broadcast(starts), [_ORDER, _RANGE]).groupBy(_ROW).agg(
        *[F.max(F.when(F.col(_ORDER) == k, number)).alias(name) for k, name in enumerate(ranks)]
    )
    return rows.join(numbered, _ROW).select(*[f"`{c}`" for c in df.columns], *[f"`{n}`" for n in ranks])


def array_chunks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie_break: str,
    name: str,
    chunk_size: int = 1000,
) -> DataFrame:
    """``array_agg(value order by value)`` per key, in arrays of bounded length.

    One array per key would gather a hot key in a single cell. Each key gets
    as many numbered chunks as it needs; their concatenation is the whole
    aggregate. Nulls are kept.
    """
    order = [F.col(value).asc_nulls_last(), F.col(tie_break).asc_nulls_last()]
    numbered = number_within(df.select(*keys, value, tie_break), keys, order, "_n")
    members = F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v"))))
    return (
        numbered.withColumn("chunk", F.expr(f"(_n - 1) div {chunk_size}"))
        .groupBy(*keys, "chunk")
        .agg(F.transform(members, lambda member: member["v"]).alias(name))
    )
