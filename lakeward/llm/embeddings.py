"""Embedding near-dedup by int8 tile products with a rigorous error bound per vector.

Each unit vector u is written as s*q + e with an int8 vector q, a scale s and a
rest e whose length is known. For two vectors

    |u.v - s*t*(q.p)| <= |s*q|*|f| + |e|*|t*p| + |e|*|f|

so the integer product of a tile pair shows which pairs can reach the
threshold; only those are computed in double precision. No pair at or above the
threshold is missed and none below it is linked.

Vectors of one label (and one dimension) are dealt by hash into blocks of about
``BLOCK`` rows, so a hot label is many blocks, and a task gets one pair of
blocks. Equal vectors of a label are one row with a count. A task returns one
row per vector that has links: the number of vectors it is linked to and the
smallest vector its links reach in the task, never the pairs themselves. The
work of the tile products grows with the square of a label's distinct vectors;
that is the method's cost, and it is spread evenly over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeward.llm.common import ship_package
from lakeward.llm.components import connected_components
from lakeward.session import stage

THRESHOLD = 0.98
BLOCK = 4096
TILE = 512
_RECHECK = 1 << 15  # pairs computed in double precision at a time
_FLOAT32_DIMENSIONS = 1000  # up to here sums of int8 products are exact in float32
_ROUNDING = 1e-9  # far above what double precision loses in the bound itself


def quantize(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the scaled rows and of the rests."""
    scale = np.abs(unit).max(axis=1) / 127.0
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


class Tile:
    """Rows of a block, in full precision and quantised."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, place: np.ndarray):
        # A power of two brings the largest component near 1: no bit changes, and no square overflows or vanishes.
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.vectors, self.weights, self.place = vectors, weights, place
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        whole, self.scale, self.length, self.rest = quantize(vectors / self.norms[:, None])
        exact = np.float32 if vectors.shape[1] <= _FLOAT32_DIMENSIONS else np.float64
        self.whole = whole.astype(exact)  # integers: the product below is an exact integer one


def tile_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``a`` and ``b`` of all pairs with a cosine of at least ``threshold``."""
    product = (a.whole @ b.whole.T).astype(np.float64)
    product *= a.scale[:, None] * b.scale[None, :]
    product += a.length[:, None] * b.rest[None, :] + a.rest[:, None] * (b.length + b.rest)[None, :]
    i, j = np.nonzero(product >= threshold - _ROUNDING)
    kept = []
    for at in range(0, len(i), _RECHECK):
        x, y = i[at : at + _RECHECK], j[at : at + _RECHECK]
        dots = np.einsum("ij,ij->i", a.vectors[x], b.vectors[y])
        kept.append(dots / (a.norms[x] * b.norms[y]) >= threshold)
    good = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[good], j[good]


def _merge(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in ``top`` (every row's smallest known row), in place."""
    while True:
        a, b = top[i], top[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = top[top]
            if (up == top).all():
                break
            top[:] = up


def block_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``rep, links, least`` of the vectors with links within one pair of blocks."""
    group = group.sort_values("rep", kind="stable")
    ids, blocks = group["rep"].to_numpy(np.int64), group["block"].to_numpy()
    weights = group["n"].to_numpy(np.int64)
    vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])

    def tiles(block: int) -> list[Tile]:
        rows = np.nonzero(blocks == block)[0]
        parts = [rows[at : at + TILE] for at in range(0, len(rows), TILE)]
        return [Tile(vectors[p], weights[p], p) for p in parts]

    left = tiles(lo)
    right = left if lo == hi else tiles(hi)
    found, top = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for m, a in enumerate(left):
        for b in right[m:] if lo == hi else right:
            i, j = tile_links(a, b, threshold)
            if a is b:
                i, j = i[i < j], j[i < j]
            np.add.at(found, a.place[i], b.weights[j])
            np.add.at(found, b.place[j], a.weights[i])
            _merge(top, a.place[i], b.place[j])
    linked = found > 0
    return pd.DataFrame({"rep": ids[linked], "links": found[linked], "least": ids[top[linked]]})


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    Rows are compared when their labels are equal and not null and their
    vectors have the same number of components. A vector that is null, empty,
    zero, or holds a null or non-finite component, and a row without an id or
    label, links with nothing: no links, itself as component. ``kept`` is true
    where the row's id is that of its component (false without an id). Repeated
    rows are copies of each other like any other equal vectors. Runs Spark jobs
    while it is called.
    """
    ship_package(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"),
    )
    rows = rows.withColumn(
        "ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    )
    rows = stage(rows, "vectors")
    good = rows.where("ok").drop("ok")
    classes = stage(
        good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("vector")),
        "classes",
    )
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (
        classes.join(sizes, ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    )
    found = stage(
        dealt.groupBy("label", "dim", "lo", "hi").applyInPandas(
            lambda group: block_links(group, threshold), "rep long, links long, least long"
        ),
        "links",
    )
    component = connected_components(found, "rep", "least").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "rep", "left").join(component, "rep", "left").select(
        "label", "vector",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = good.join(of_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
