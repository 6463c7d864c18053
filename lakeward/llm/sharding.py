"""A reproducible shuffle: a Feistel permutation with cycle walking over row numbers.

Rows get their global number in id order; a keyed permutation of 0..n-1 gives
each its place in the shuffled order, and place modulo the number of shards is
the shard, place divided by it the slot. Both follow from the number, the total
and the key alone, and ``row_number_at`` goes back from shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lakeward.llm.common import documents, ship_package
from lakeward.operators.ranking import number_rows
from lakeward.session import stage

KEY = 20_240_229
ROUNDS = 6
SHARDS = 8


def _half_bits(total: int) -> int:
    """Bits of one half of the smallest even-width domain that holds ``total`` values."""
    return max(1, (max(total - 1, 1).bit_length() + 1) // 2)


def _mix(values: np.ndarray, key: int, turn: int) -> np.ndarray:
    """The round function: a 64-bit finalizer over the half, the key and the round."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _network(values: np.ndarray, bits: int, key: int, turns: list[int]) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & low
    for turn in turns:
        left, right = right, left ^ (_mix(right, key, turn) & low)
    # swapped once more, so that the same rounds backwards undo it
    return (right << np.uint64(bits)) | left


def _walk(values, total: int, key: int, turns: list[int]) -> np.ndarray:
    out = np.asarray(values, np.int64).astype(np.uint64)
    if total <= 1:
        return out.astype(np.int64)
    bits = _half_bits(total)
    away = np.arange(len(out))
    while len(away):  # under four values of the domain per value wanted, so few turns
        out[away] = _network(out[away], bits, key, turns)
        away = away[out[away] >= total]
    return out.astype(np.int64)


def permute(numbers, total: int, key: int = KEY) -> np.ndarray:
    """Places of the row numbers 0..total-1 in the shuffled order; a bijection."""
    return _walk(numbers, total, key, list(range(ROUNDS)))


def unpermute(places, total: int, key: int = KEY) -> np.ndarray:
    """The row numbers at the given places."""
    return _walk(places, total, key, list(range(ROUNDS))[::-1])


def row_number_at(shard: int, slot: int, total: int, shards: int = SHARDS, key: int = KEY) -> int:
    """Global number of the row in a slot of a shard."""
    return int(unpermute([slot * shards + shard], total, key)[0])


def assign(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    key: int = KEY,
) -> DataFrame:
    """``doc_id, size, text_crc32, row, shard, slot`` for every row, law ``rows``.

    Shards differ by at most one row; slots run from 0 without a gap. Rows are
    numbered by id (nulls last), ties by checksum and size; rows alike in all
    three can stand for each other. A null text has size 1 and a null checksum.
    The texts stay where they are read: only id, size and checksum move.
    """
    small = documents(df, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    order = [F.col(c).asc_nulls_last() for c in ("doc_id", "text_crc32", "size")]
    numbered = stage(number_rows(small, order, "row"), "numbered")
    total = numbered.count()
    ship_package(df.sparkSession)

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, key))

    at = numbered.withColumn("row", F.col("row") - 1).withColumn("_place", place("row"))
    return at.select(
        "doc_id", "size", "text_crc32", "row",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
    )
