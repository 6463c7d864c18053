"""Files that are narrow in several columns at once.

A sort on ``(tenant, time)`` leaves every file as wide in time as its tenant is. Here
the ranks of the columns' values among equally filled ranges have their bits
interleaved, and rows are written in the order of that number, so a file spans a
small box: a filter on any one of the columns skips most files by their statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

BITS = 6  # ranges of a column: 2 ** BITS
SAMPLED = 100  # sampled rows for each range; with BITS they bound what reaches the driver
_TEXT = 256  # characters of a text border


def borders(df: DataFrame, columns: Sequence[str], bits: int = BITS, seed: int = 42) -> dict[str, list]:
    """Where the ranges of each column begin, from ``SAMPLED * 2 ** bits`` rows drawn of all.

    A value that fills several ranges is one border; nulls have none. The borders
    decide where rows lie, never which rows there are.
    """
    ranges = 1 << bits
    picked = [
        (F.substring(_at(c), 1, _TEXT) if isinstance(df.schema[c].dataType, T.StringType) else _at(c)).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    drawn = df.select(F.rand(seed).alias("r"), *picked).orderBy("r").limit(SAMPLED * ranges).collect()
    out = {}
    for i, column in enumerate(columns):
        values = sorted(r[f"c{i}"] for r in drawn if r[f"c{i}"] is not None and r[f"c{i}"] == r[f"c{i}"])
        cuts = {values[len(values) * k // ranges] for k in range(1, ranges)} if values else set()
        out[column] = sorted(cuts - {values[0]} if values else cuts)
    return out


def _at(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def range_rank(column: Column, cuts: Sequence) -> Column:
    """How many borders are at or below a value; null counts as below all, NaN as above all."""

    def between(low: int, high: int) -> Column:
        # A balanced tree of comparisons: as many as the rank has bits.
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(column.isNull(), F.lit(0)).otherwise(between(0, len(cuts)))


def interleaved(ranks: Sequence[tuple[Column, int]], bits: int = BITS) -> Column:
    """One long of the bits of ``(rank, greatest rank)`` columns, the highest bits of all first.

    A column with few ranks is shifted up, so that it parts the rows as early as the others.
    """
    if len(ranks) * bits > 63:
        raise ValueError(f"{len(ranks)} columns of {bits} bits do not fit in a long")
    parts = []
    for place, (rank, greatest) in enumerate(ranks):
        wide = F.shiftleft(rank.cast("long"), bits - greatest.bit_length())
        for bit in range(bits):
            target = bit * len(ranks) + len(ranks) - 1 - place
            parts.append(F.shiftleft(F.shiftright(wide, bit).bitwiseAND(F.lit(1)).cast("long"), target))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def clustered(df: DataFrame, columns: Sequence[str], files: int | None = None, bits: int = BITS) -> DataFrame:
    """``df`` dealt into ranges of the interleaved ranks and sorted in them, ready to be written.

    One sampling job and one range exchange. Without ``files`` adaptive execution
    chooses how many by size. Rows of one cell are parted by the columns' values and a
    hash of the row, so a hot tenant, or a hot value of all the columns together, takes
    as many files as it fills.
    """
    if not columns:
        raise ValueError("name the columns to cluster by")
    if files is not None and files < 1:
        raise ValueError("at least one file")
    cuts = borders(df, columns, bits)
    key = interleaved([(range_rank(_at(c), cuts[c]), len(cuts[c])) for c in columns], bits)
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = [key, *map(_at, columns), F.xxhash64(*map(_at, hashable))]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    return dealt.sortWithinPartitions(key, *map(_at, columns))


def file_spans(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``file, rows, low_0, high_0, ..``: what a file's statistics say of each column, a row per file.

    ``files`` is a frame read from files, with its ``_metadata``.
    """
    spans = [f(_at(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]
    return files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *spans)


def share_read(files: DataFrame, columns: Sequence[str], column: str, low, high) -> float:
    """Share of the files that a filter ``column between low and high`` has to open."""
    i = list(columns).index(column)
    meets = (F.col(f"low_{i}") <= F.lit(high)) & (F.col(f"high_{i}") >= F.lit(low))
    return file_spans(files, columns).agg(F.avg(F.when(meets, 1.0).otherwise(0.0))).first()[0]
